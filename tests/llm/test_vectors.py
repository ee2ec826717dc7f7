"""Codes, clusters and fingerprints against plain versions, and over odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from quire.llm import centroids, codes, fingerprints
from quire.llm._vectors import LIMIT

NAN, INF = float("nan"), float("inf")


def near(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(entries))


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


# ---------------------------------------------------------------- codes
def plain_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for _, v, _ in kept:
                by.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(by[e]) for c in zip(*by[e], strict=True)] if e in by else old for e, old in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return out, books


@pytest.mark.parametrize("n,parts,entries", [(3, 2, 4), (120, 4, 8), (90, 16, 64)])
def test_codes_equal_plain_ones(spark, n, parts, entries):
    rng = random.Random(n)
    rows = [(k, [rng.gauss(0, 1) for _ in range(parts * 2)], k % 3 or None) for k in range(n)]
    rows += [(n + k, rows[0][1], 7) for k in range(n // 2)] + [(5, rows[1][1], 1), (None, rows[2][1], None)]  # a common vector, a repeated and a null id
    rng.shuffle(rows)
    got, books = codes.compress_vectors(table(spark, rows).repartition(5), parts=parts, entries=entries)
    want, plain = plain_codes(rows, parts, entries, 2)
    assert books.tolist() == plain
    by = {}
    for _, _, e, label in want:
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, c, e, by[label], sha)) for i, c, e, label in want)
    back = [r[0] for r in got.select(codes.decode(got["code"], books)).collect()]
    assert all(len(b) == parts * 2 for b in back)


def test_codes_of_odd_rows(spark):
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [NAN, 1.0], 1), (4, [-INF, 1.0], 1), (5, [1.0], 1), (6, [0.5, -0.001], 1), (7, [], 1), (8, [1e30, 0.0], None), (9, [0.5, 0.25], None)]
    got, books = codes.compress_vectors(table(spark, rows), parts=2, entries=4)
    assert books.shape == (2, 2, 1)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got.collect()} == {5: (None, None, 0), 6: ("0000", 0, 0), 7: (None, None, 0), 8: (None, None, 0), 9: ("0001", 0, 0)}
    for rows in ([], [(1, None, 2)], [(1, [1.0], 2)]):
        got, books = codes.compress_vectors(table(spark, rows), parts=2)
        assert [tuple(r)[:4] for r in got.collect()] == ([(1, None, None, None)] if rows and rows[0][1] else []) and books.size == 0


def test_codes_with_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a", 5, "x"), (2, [3.0, 4.0], "a", 6, "y")], "vec_id long, embedding array<float>, label string, id int, q string")
    got, _ = codes.compress_vectors(df, parts=2)
    assert sorted((r["vec_id"], r["code"], r["label_error"]) for r in got.collect()) == [(1, "0000", 0), (2, "0101", 0)]


# ---------------------------------------------------------------- centroids
def plain_clusters(rows, clusters, rounds, width, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if len(v) == width]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in kept[:clusters]]
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v, cs)[1], []).append(v)
        cs = [[sum(x) // len(by[c]) for x in zip(*by[c], strict=True)] if c in by else old for c, old in enumerate(cs)]
    return [(i, *near(v, cs)[::-1]) for i, v in kept], cs


@pytest.mark.parametrize("n,clusters,rounds", [(2, 8, 10), (300, 5, 10), (2500, 4, 3)])
def test_clusters_equal_plain_ones(spark, n, clusters, rounds):
    rng = random.Random(n)
    rows = [(k, [rng.gauss(k % 3, 0.5) for _ in range(3)]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 2)] + [(5, rows[1][1]), (None, rows[1][1])]
    rng.shuffle(rows)
    got, cs = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), clusters=clusters, rounds=rounds, width=3)
    want, plain = plain_clusters(rows, clusters, rounds, 3)
    assert cs.tolist() == plain
    by = {}
    for _, c, d in want:
        by[c] = by.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in plain]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, c, d, by[c], sum(by.values()), sha[c])) for i, c, d in want)


def test_heavy_weights_stay_exact(spark):
    """Sums far beyond a long: a weight as large as a corpus on the largest components."""
    rows = [([LIMIT - 1, -LIMIT + 1], (1 << 61) + 12345), ([LIMIT - 2, -LIMIT + 3], (1 << 60) + 1)]
    got = centroids._weighted(spark.createDataFrame(rows, "q array<int>, n long"), np.array([[0, 0]]))
    assert got == {0: (sum(n for _, n in rows), [sum(v[i] * n for v, n in rows) for i in range(2)])}


def test_clusters_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [1.0, None], 0), (3, [NAN, 1.0], 0), (4, [1.0], 0), (5, [1e30, 1.0], 0), (6, [0.5, 0.25], 0), (6, [0.5, 0.25], 0)], "vec_id long, embedding array<double>, cluster int")
    got, _ = centroids.cluster_vectors(df, width=2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in got.collect() if r["vec_id"] != 5) == [(6, 0, 0, 0, 0)] * 2
    assert [tuple(r) for r in got.filter("vec_id = 5").collect()] == [(5, None, None, None, 0, None)]
    for few in (df.limit(0), df.filter("vec_id = 1")):
        assert centroids.cluster_vectors(few, width=2)[0].collect() == []


# ---------------------------------------------------------------- fingerprints
def plain_hashes(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    out = set()
    for i in range(max(len(ws) - 4, 1) if ws else 0):
        seed = 42
        for w in ws[i : i + 5]:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        out.add(seed - (1 << 64) if seed >= 1 << 63 else seed)
    return out


def plain_likeness(a, b, k):
    if not a and not b:
        return 1.0
    low = sorted(a | b)[:k]
    return len([x for x in low if x in a and x in b]) / len(low)


def plain_edited(rows, k):
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, (x := xxhash.xxh64_intdigest(r[1].encode(), 42)) - (1 << 64) * (x >= 1 << 63), r[1]))
    out = {}
    for at, (i, t) in enumerate(docs):
        follow = docs[(at + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        s, e, f = (sorted(plain_hashes(x))[:k] for x in (t, edited, follow))
        text = lambda h: "".join(f"{x % (1 << 64):016x}" for x in h)
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(s), text(e), plain_likeness({*s}, {*e}, k), plain_likeness({*s}, {*f}, k))
    return out


@pytest.mark.parametrize("range_rows", [1, 3, 4096])
def test_fingerprints_equal_plain_ones(spark, range_rows):
    rng = random.Random(range_rows)
    vocabulary = [f"W{x}ö" if x % 3 else f"{x}a" for x in range(60)] + [" ", "𝔸"]
    texts = ["", None, " \t ", "one", "Two words", "A b\tC\nd e", "a b c d e f"] + [" ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 120]))) for _ in range(25)]
    rows = [(k * 7, t) for k, t in enumerate(texts)] + [(7, "same id"), (7, "same id"), (None, "no id"), (None, "no id, too"), (200, texts[-1]), (201, texts[-1])]
    rng.shuffle(rows)
    got = fingerprints.edited_likeness(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spot string, range int"), k=16, range_rows=range_rows)
    want = plain_edited(rows, 16)
    assert sorted(map(repr, (tuple(r)[:7] for r in got.collect()))) == sorted(repr((i, *want[i, t or ""])) for i, t in rows)


def test_fingerprints_of_small_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    (row,) = fingerprints.edited_likeness(df).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()
    assert fingerprints.edited_likeness(df.limit(0)).collect() == []
    (row,) = fingerprints.edited_likeness(df.selectExpr("cast(null as long) doc_id", "cast(null as string) text")).collect()
    assert (row["n_chars"], row["fingerprint"], row["near_edited"]) == (0, "", 1.0)


def test_sketches_merge_and_estimate(spark):
    long_ = [" ".join(f"w{x}" for x in range(at, at + 6000)) for at in (0, 2000)]
    df = spark.createDataFrame([(k % 2, t) for k, t in enumerate([*long_, "", None])] + [(2, None)], "part int, text string")
    s = fingerprints.fingerprints(df.selectExpr("part doc_id", "text"))
    whole = {r["doc_id"]: r["sketch"] for r in fingerprints.merged(s, ["doc_id"], "sketch").collect()}
    all_ = set().union(*map(plain_hashes, long_))
    assert whole == {0: sorted(plain_hashes(long_[0]))[:256], 1: sorted(plain_hashes(long_[1]))[:256], 2: []}
    assert [r["sketch"] for r in fingerprints.merged(s, [], "sketch").collect()] == [sorted(all_)[:256]]
    two = spark.createDataFrame([(whole[0], whole[1])], "a array<bigint>, b array<bigint>")
    r = two.select(fingerprints.resemblance(two.a, two.b), fingerprints.containment(two.a, two.b), fingerprints.distinct_count(two.a), fingerprints.merge(two.a, two.b), fingerprints.decode(fingerprints.encode(two.a))).first()
    assert abs(r[0] - 0.5) < 0.1 and abs(r[1] - 2 / 3) < 0.12 and abs(r[2] / 5996 - 1) < 0.2 and r[3] == sorted(all_)[:256] and r[4] == whole[0]
