"""Sharding: a Feistel permutation of global row numbers, with cycle walking; DataFrame operations only.

`shard_documents` numbers all rows without gaps, permutes the numbers and deals them out: the shard of a
row is its permuted number modulo the shard count and its slot the quotient, so both are computed, shard
sizes differ by one at most (law `rows`), and a seed gives the same shuffle again.

Row numbers need no global sort: rows are counted in BUCKETS hash buckets, the bucket sizes are
prefix-summed (BUCKETS rows, broadcast), and each bucket numbers its own. Equal rows are counted before the
shuffle, and their numbers go out in runs of RUN, dealt over all tasks before they become rows, so a row repeated any number of
times is no hot key.

Defined cases: a null text has size 1 and checksum 0; a null doc_id is a value like others; very long texts count by their bytes;
equal rows get distinct slots; rows that tie in doc_id, size and checksum are equal rows here; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets in which rows are numbered; the table of their sizes has this many rows at most.
BUCKETS = 2048
#: Numbers of a repeated row that one task spreads out at a time.
RUN = 10_000
#: Feistel rounds, and walks after which a row number outside the table is an error (its odds are rows**-WALKS/2).
ROUNDS, WALKS = 4, 64


def _permuted(p: str, seed: int) -> str:
    """SQL of one Feistel pass over [0, side * other): p = left * other + right, halves are shifted in turn by a keyed hash."""
    left, right = f"(({p}) div other)", f"pmod({p}, other)"
    steps = []
    for i in range(ROUNDS):
        if i % 2:
            steps.append(f"s -> named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64({seed + i}L, s.l), other), other))")
        else:
            steps.append(f"s -> named_struct('l', pmod(s.l + pmod(xxhash64({seed + i}L, s.r), side), side), 'r', s.r)")
    state = f"array(named_struct('l', {left}, 'r', {right}))"
    for step in steps:
        state = f"transform({state}, {step})"
    return f"transform({state}, s -> s.l * other + s.r)[0]"


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, position, shard, slot) of every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int")
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    sizes = kinds.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    every = Window.orderBy("bucket")
    sizes = sizes.select(
        "bucket",
        (F.sum("in_bucket").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).alias("before"),
        F.sum("in_bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    sizes = sizes.withColumn("side", F.ceil(F.sqrt("total"))).withColumn("other", F.expr("(total + side - 1) div side"))
    order = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = kinds.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.join(F.broadcast(sizes), "bucket")
    first = F.col("before") + F.col("upto") - F.col("n")
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run")
    dealt = numbered.select("doc_id", "size", "text_crc32", "total", "side", "other", first.alias("first"), "n", runs).repartition("doc_id", "size", "text_crc32", "run")
    own = F.sequence(F.col("first") + F.col("run") * RUN, F.col("first") + F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)
    spread = dealt.select("doc_id", "size", "text_crc32", "total", "side", "other", F.explode(own).alias("row"))
    once = spread.withColumn("position", F.expr(_permuted("row", seed)))
    walked = f"aggregate(sequence(1, {WALKS}), position, (p, i) -> if(p < total, p, {_permuted('p', seed)}))"
    landed = once.withColumn("position", F.expr(f"if(position < total, position, {walked})"))
    landed = landed.withColumn("position", F.expr("if(position < total, position, raise_error('a row number never came back into the table'))"))
    return landed.select("doc_id", "size", "text_crc32", "position", F.pmod("position", F.lit(shards)).cast("int").alias("shard"), F.expr(f"position div {int(shards)}").alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under law `rows`."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
