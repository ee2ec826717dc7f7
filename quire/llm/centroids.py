"""Centroid clustering over distinct vectors: Lloyd's rounds on integers, each distinct vector weighted by its copies.

Vectors become integers, equal ones are grouped with their multiplicity, and all rounds run over the distinct vectors
only, a table written once. A round is one Arrow pass that adds up weighted sums per task, merged by a shuffle of one
row a cluster and task; the driver sees one row a cluster. At the end the clusters are joined back to the ids: vectors
that make up a thousandth of the rows or more, of which there are at most a thousand, by a broadcast, so that no
common vector lands in one task; the others by a shuffle on the vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._vectors import BLOCK, in_range, integers, matrix, nearest, whole

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
#: A vector with this share of the rows or more counts as common; there are at most 1 / share of them.
COMMON = 1 / 1000
_DIGIT = 21


def _weighted(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster: the weight of its vectors, and their weighted component sums, exact."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, totals = [0] * k, [[0] * width for _ in range(k)]
        for batch in batches:
            rows, w = matrix(batch.column(0), width), batch.column(1).to_numpy()
            for at in range(0, len(rows), BLOCK):
                x, own = rows[at : at + BLOCK], w[at : at + BLOCK]
                index = nearest(x[None], centroids[None])[0][0]
                # a weight is split into three digits, so that no sum of a block leaves the range of int64
                for shift in (0, _DIGIT, 2 * _DIGIT):
                    digit = (own >> shift) & ((1 << _DIGIT) - 1)
                    if digit.any():
                        for c in np.unique(index):
                            mine = index == c
                            weight[c] += int(digit[mine].sum()) << shift
                            totals[c] = [a + (int(b) << shift) for a, b in zip(totals[c], digit[mine] @ x[mine], strict=True)]
        used = [c for c in range(k) if weight[c]]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([Decimal(weight[c]) for c in used], kind), pa.array([[Decimal(s) for s in totals[c]] for c in used], pa.list_(kind))], names=["cluster", "w", "sums"])

    found = distinct.mapInArrow(sums, "cluster int, w decimal(38,0), sums array<decimal(38,0)>")
    by = found.groupBy("cluster").agg(F.sum("w").alias("w"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    return {r["cluster"]: (int(r["w"]), [int(r[f"s{i}"]) for i in range(width)]) for r in by.collect()}  # one row a cluster


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct (q, n) with cluster and distance."""
    width = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0), width)
            index, least = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
            for at in range(0, len(rows), BLOCK):
                i, d = nearest(rows[None, at : at + BLOCK], centroids[None])
                index[at : at + BLOCK], least[at : at + BLOCK] = i[0], d[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index), pa.array(least)], names=["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(assign, "q array<int>, n long, cluster int, distance long")


def train_centroids(distinct: DataFrame, first: list[list[int]], rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many rounds over distinct (q, n); rounds that would change nothing more are left out."""
    centroids = np.array(first, np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (w, sums) in _weighted(distinct, centroids).items():
            moved[c] = [s // w for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def _as_long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): the cluster of every vector of df with ``width`` components, none null or non-finite.

    Rows are id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. The first centroids are the
    vectors with the least SHA-256 of ``seed:id``; repeated rows count each, in the order of their integers, and a null
    id comes last. With fewer vectors than clusters there are as many centroids as vectors. A vector with a component
    whose integer is beyond ``LIMIT`` teaches nothing and has a null cluster. Inertias beyond a long are null. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    v = F.col(vector_col)
    base = df.filter((F.size(v) == width) & whole(v)).select(F.col(id_col).alias("id"), F.when(in_range(v, scale), integers(v, scale)).alias("q"))
    usable = base.filter(F.col("q").isNotNull())
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = [r["q"] for r in usable.select(draw.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()]
    if not first:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return base.select(F.col("id").alias(id_col), *empty), np.zeros((0, width), np.int64)
    distinct = written(usable.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    centroids = train_centroids(distinct, first, rounds)
    assigned = written(_assigned(distinct, centroids), "assigned")
    by = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    inertia = {c: int(r["s"]) for c, r in by.items()}
    rows = sum(r["n"] for r in by.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = F.create_map(*[x for c, s in inertia.items() for x in (F.lit(c), F.struct(F.lit(_as_long(s)).cast("long").alias("i"), F.lit(hashes[c]).alias("h")))])
    common = F.col("n") >= F.lit(max(1, int(rows * COMMON)) if rows * COMMON == int(rows * COMMON) else int(rows * COMMON) + 1)
    few = F.broadcast(assigned.filter(common).drop("n"))  # 1 / COMMON rows at most, as their copies add up to the rows
    most = base.join(few.select("q"), "q", "left_anti").join(assigned.filter(~common).drop("n"), "q", "left")
    out = base.join(few, "q").unionByName(most)
    fact = facts[F.col("cluster")]
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", F.when(F.col("cluster").isNotNull(), fact["i"]).alias("cluster_inertia"),
        F.lit(_as_long(sum(inertia.values()))).cast("long").alias("inertia"), F.when(F.col("cluster").isNotNull(), fact["h"]).alias("centroid_sha256")), centroids
