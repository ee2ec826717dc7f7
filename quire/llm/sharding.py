"""Reproducible shuffle and sharding by a keyed permutation of global row numbers.

Every row gets a gapless number 0..n-1 that depends on the rows alone, not on how they are stored. A Feistel network
over pairs (l, r) of Z_a x Z_b, with a = ceil(sqrt n) and b = ceil(n / a), permutes 0..a*b-1; an image of n or more
is permuted again (cycle walking) until it is below n. The permuted number p gives shard p mod k and slot p div k, so
shard sizes are at most one apart, slots have no gaps, and the place of any row number can be computed, and inverted,
without the data.

Everything here is a DataFrame expression; only the counts of the hash buckets (a fixed number of rows) are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._native import let

BUCKETS = 1024
ROUNDS = 6
WALKS = 40


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mixed(x: Column, key: int, round_: int, below: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(key).cast("long"), F.lit(round_)), F.lit(below).cast("long"))


def permuted_once(x: Column, n: int, key: int) -> Column:
    """One pass of the Feistel network over 0..a*b-1."""
    a, b = _sides(n)
    wide = F.lit(b).cast("long")

    def step(s: Column, i: int) -> Column:
        if i % 2:
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + _mixed(s["l"], key, i, b), wide).alias("r"))
        return F.struct(F.pmod(s["l"] + _mixed(s["r"], key, i, a), F.lit(a).cast("long")).alias("l"), s["r"].alias("r"))

    # each round adds a keyed function of one side to the other; the sides keep their own modulus, so any a * b works
    state = F.struct(F.floor(x / wide).cast("long").alias("l"), F.pmod(x, wide).alias("r"))
    for i in range(ROUNDS):
        state = let(state, lambda s, i=i: step(s, i))
    return let(state, lambda s: s["l"] * wide + s["r"])


def permute(x: Column, n: int, key: int) -> Column:
    """The keyed permutation of 0..n-1 (n known), as a column.

    A walk passes each of the a*b-n < a images outside at most once, so for n up to WALKS squared it always ends in
    WALKS passes; beyond, a longer walk has a chance under n ** (-WALKS / 2) and raises an error instead of a wrong row.
    """
    first = permuted_once(x, n, key)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        first,
        lambda v, _: F.when(v < n, v).otherwise(permuted_once(v, n, key)),
    )
    return let(walked, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk not ended")).cast("long")))


def permute_number(x: int, n: int, key: int, mix) -> int:
    """The same for one number, outside Spark; mix(value, key, round) is a signed 64-bit hash equal to xxhash64."""
    a, b = _sides(n)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + mix(left, key, i) % b) % b
            else:
                left = (left + mix(right, key, i) % a) % a
        x = left * b + right
        if x < n:
            return x


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number", buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """df with a gapless global row number from 0, and the number of rows.

    Rows go to buckets by a hash of the order columns and are numbered within each bucket in their order; a bucket
    starts where those before it end. No task gets more than about 1/buckets of the rows, and no sort is global. Rows
    equal in all order columns are interchangeable. Columns of df named like the ones added here are replaced.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets).cast("long")).cast("int"))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.orderBy("_bucket").collect()  # at most `buckets` rows of two numbers
    starts, n = [], 0
    for r in rows:
        starts.append((r["_bucket"], n))
        n += r["_n"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_bucket int, _start long")
    w = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = keyed.withColumn("_place", F.row_number().over(w)).join(F.broadcast(offsets), "_bucket")
    return out.withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_bucket", "_place", "_start"), n


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", key: int = 20240229) -> DataFrame:
    """Shard and slot of every row of df under the law ``rows``.

    Returns id_col, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, law, row_number, shard,
    slot and grown_shard (null: the law is not ``key``). A null id is a value like any other; repeated rows each get a
    slot of their own; empty tables give no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    numbered, n = row_numbers(slim, ["_id", "_crc", "_size"])
    placed = numbered.withColumn("_p", permute(F.col("row_number"), n, key))
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
