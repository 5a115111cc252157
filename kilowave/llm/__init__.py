"""Training-corpus operators; nothing outside this folder imports it except the guarded entry point."""
