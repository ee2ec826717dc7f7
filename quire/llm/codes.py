"""Vector code compression: each vector becomes one byte a part, the index of the nearest entry of that part's codebook.

Codebooks hold integers and are small (parts x entries x width numbers), so every round ships them with the tasks. Arrow
batches of vectors compute the distances to all entries by the expansion |x|^2 - 2 x.c + |c|^2 with int64 matrix
products and take the first least one. Sums and counts of the parts of each entry are added up per task and merged by a
grouped shuffle, at most parts x entries rows a task; the driver sees one row for each entry and takes exact floors.
Vectors are read anew in each round and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import written
from ._vectors import BLOCK, in_range, integers, matrix, nearest, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels whose sums are broadcast to the coded rows: so many at most, of so many characters in all.
BROADCAST_LABELS, BROADCAST_CHARS = 100_000, 4_000_000


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x (parts * width) as parts x rows x width."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def _summed(vectors: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry: how many vectors are nearest to it, and the sums of their components."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(parts * entries, np.int64), np.zeros(parts * entries * width, np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), parts * width)
            for at in range(0, len(rows), BLOCK):
                x = _parts(rows[at : at + BLOCK], parts)
                cell = nearest(x, books)[0] + np.arange(parts)[:, None] * entries
                counts += np.bincount(cell.ravel(), minlength=len(counts))
                np.add.at(totals, (cell[:, :, None] * width + np.arange(width)).ravel(), x.ravel())
        used = np.flatnonzero(counts)
        by = totals.reshape(-1, width)[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(counts[used]), pa.array(list(by), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = vectors.mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    # decimals: sums over all vectors of a corpus may leave the range of a long
    columns = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect()  # parts x entries at most
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def _first_vectors(df: DataFrame, entries: int, parts: int) -> list[list[int]]:
    """The integer vectors of the smallest ids, of the length of the very first; none if no vector can be cut."""
    order = [F.col("id").asc_nulls_last(), F.col("q")]
    usable = df.filter(F.col("q").isNotNull() & (F.size("q") > 0) & (F.size("q") % parts == 0)).select("id", "q")
    first = [r["q"] for r in usable.orderBy(*order).limit(entries).collect()]
    if len({len(q) for q in first}) > 1:
        first = [r["q"] for r in usable.filter(F.size("q") == len(first[0])).orderBy(*order).limit(entries).collect()]
    return first


def train_codebooks(vectors: DataFrame, first: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width, int64) after so many rounds over vectors, whose one column has lists of integers."""
    books = _parts(np.array(first, np.int64), parts)
    for _ in range(rounds):
        books = books.copy()
        for (part, entry), (n, sums) in _summed(vectors, books).items():
            books[part, entry] = [s // n for s in sums]
    return books


def _coded(df: DataFrame, books: np.ndarray) -> DataFrame:
    """df (id, label, q) with code and error in place of q; null where q is null."""
    parts, entries, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            rows = matrix(batch.column(2), parts * width)
            text, error = [None] * len(batch), np.zeros(len(batch), np.int64)
            for at in range(0, len(rows), BLOCK):
                index, least = nearest(_parts(rows[at : at + BLOCK], parts), books)
                error[there[at : at + BLOCK]] = least.sum(axis=0)
                for i, code in zip(there[at : at + BLOCK], index.T.astype(np.uint8), strict=True):
                    text[i] = code.tobytes().hex()
            missing = np.ones(len(batch), bool)
            missing[there] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, mask=missing)], names=["id", "label", "code", "error"])

    fields = df.schema.fields
    return df.mapInArrow(codes, T.StructType([fields[0], fields[1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def _none_coded(df: DataFrame) -> DataFrame:
    return df.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): a code for every vector of df that is there and has no null or non-finite component.

    Rows are id, code, error, label_error, codebooks_sha256; the codebooks are parts x entries x width integers. Rows of
    one id each have a code, and are ordered by their integers where ids tie; a null id comes last. With fewer vectors
    than entries the codebooks have as many entries as there are vectors. The length that is cut is that of the first
    vector whose length the parts divide; a vector of another length, or with a component whose integer is beyond
    ``LIMIT``, teaches nothing and has a null code and error. label_error sums the errors of equal labels, nulls
    together. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256: an index has two hexadecimal digits")
    v = F.col(vector_col)
    kept = df.filter(whole(v)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(in_range(v, scale), integers(v, scale)).alias("q"))
    first = _first_vectors(kept, entries, parts)
    if first:
        alike = F.size("q") == len(first[0])
        books = train_codebooks(kept.filter(alike).select("q"), first, parts, rounds)
        coded = written(_coded(kept.withColumn("q", F.when(alike, F.col("q"))), books), "codes")
    else:
        books, coded = np.zeros((parts, 0, 0), np.int64), _none_coded(kept)
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    size = sums.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_label").cast("string")).cast("long")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_LABELS and size["chars"] <= BROADCAST_CHARS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")), books


def decode(code: Column, books: np.ndarray) -> Column:
    """The integers that a code stands for; null for null."""
    parts = [F.array(*[F.array(*[F.lit(x) for x in e]) for e in part.tolist()]) for part in books]
    return F.flatten(F.array(*[F.get(part, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")) for p, part in enumerate(parts)]))
