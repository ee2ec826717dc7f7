"""Benchmark decontamination by winnowed fingerprints, joined and then extended word by word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. Of the K-gram hashes of a text,
the smallest in each run of WINDOW - K + 1 neighbours is a fingerprint. Two texts that share WINDOW consecutive words
share that run, and so its minimum: joining fingerprints loses no shared window. Each joined pair of positions is then
extended to both sides over the words themselves, and only runs of at least WINDOW equal words count.

An item of fewer than WINDOW words is one window. Such items are found by their first K words (or, under K words, by
all their words), taken at every position of a document; this costs a pass only if such items exist.

All of it is DataFrame functions. The benchmark side is broadcast when its counted fingerprints stay under
``broadcast_rows``; beyond, the same join shuffles on the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import ascii_lower, let

WINDOW, K = 13, 5
SIDE = WINDOW - K
#: A fingerprint is 36 bits of hash and 28 bits of word position in one long; hashes only find candidates.
POSITION_BITS = 28
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), DELIMITERS), lambda w: w != "")


def _gram(ws: Column, i: Column, m: int) -> Column:
    """Hash of the m words from position i (from 1), in the upper bits, and i in the lower bits."""
    h = F.xxhash64(F.lit(m), *[F.get(ws, i + (j - 1)) for j in range(m)])
    return F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long"))


def _grams(ws: Column, m: int) -> Column:
    return F.when(F.size(ws) >= m, F.transform(F.sequence(F.lit(1), F.size(ws) - (m - 1)), lambda i: _gram(ws, i, m))).otherwise(F.array().cast("array<long>"))


def _minima(grams: Column) -> Column:
    """The packed minima of all runs of SIDE + 1 neighbouring grams, each once."""
    return F.when(
        F.size(grams) > SIDE,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - SIDE), lambda j: F.array_min(F.slice(grams, j, SIDE + 1)))),
    ).otherwise(F.array().cast("array<long>"))


def _context(ws: Column, p: Column) -> Column:
    """SIDE words before position p, WINDOW words from it; nulls beyond the text."""
    return F.transform(F.sequence(F.lit(-SIDE - 1), F.lit(WINDOW - 2)), lambda d: F.when((p + d >= 0) & (p + d < F.size(ws)), F.get(ws, (p + d).cast("int"))))


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long")).cast("int")


def _fingerprint(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def item_fingerprints(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(fp, item, need, ictx): every position of an item whose gram attains the minimum of a run, or is a short item's key.

    Taking each position that attains a minimum, not one of them, makes the join independent of how ties are broken.
    """
    ws = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    # items with the same words are one row until the end: copies of an item do not multiply the matches
    ws = ws.groupBy("ws").agg(F.array_sort(F.collect_set("item")).alias("items"))
    long_ = ws.filter(F.size("ws") >= WINDOW).withColumn("g", _grams(F.col("ws"), K))
    low = let(_minima(F.col("g")), lambda m: F.transform(m, _fingerprint))
    long_ = long_.withColumn("g", let(low, lambda lo: F.filter("g", lambda x: F.array_contains(lo, _fingerprint(x))))).withColumn("need", F.lit(WINDOW))
    short = ws.filter(F.size("ws") < WINDOW).withColumn("need", F.size("ws"))
    key = F.lit(None).cast("long")
    for m in range(1, K + 1):
        key = F.when((F.col("need") == m) if m < K else (F.col("need") >= m), _gram(F.col("ws"), F.lit(1), m)).otherwise(key)
    short = short.withColumn("g", F.array(key))
    both = long_.select("items", "ws", "need", "g").unionByName(short.select("items", "ws", "need", "g"))
    one = both.select("items", "ws", "need", F.explode_outer("g").alias("g")).filter(F.col("g").isNotNull())
    return one.select(_fingerprint(F.col("g")).alias("fp"), "items", "need", _context(F.col("ws"), _position(F.col("g"))).alias("ictx"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit runs of word positions, from 1).

    A row is contaminated if n_hit > 0 and 20 * n_hit >= n_words. Null or empty texts have no words and no hits; null
    items are never found (no words). Rows equal in id and text are counted alike and each keep a row; an empty table
    gives no rows, an empty benchmark no hits. Other columns of docs and items are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bench = item_fingerprints(items, item_col, item_text_col)
    sizes = bench.groupBy("need").count().collect()  # at most WINDOW rows
    short = {r["need"] for r in sizes if r["need"] < WINDOW}
    if sum(r["count"] for r in sizes) <= broadcast_rows:
        bench = F.broadcast(bench)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("ws"))
    d = d.withColumn("g", _grams(F.col("ws"), K))
    found = _minima(F.col("g")) if not any(m >= K for m in short) else F.col("g")
    found = F.concat(found, *[_grams(F.col("ws"), m) for m in sorted(short) if m < K])
    d = d.select("id", "th", "ws", F.size("ws").cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("long")), found).alias("fps"))
    # the leading null keeps one row of each document through the join; a plain explode would have the optimizer infer a
    # filter from it and push that down, computing the grams again inside the lambdas
    d = d.select("id", "th", "n_words", "ws", F.explode_outer("fps").alias("packed")).withColumn("fp", _fingerprint(F.col("packed")))
    d = d.join(bench, "fp", "left").filter(F.col("items").isNotNull() | F.col("packed").isNull())
    d = d.withColumn("p", _position(F.col("packed")))
    d = d.withColumn("dctx", F.when(F.col("p").isNotNull(), _context(F.col("ws"), F.col("p"))))
    d = d.select("id", "th", "n_words", "p", "items", "need", F.array_join(F.transform(F.arrays_zip("dctx", "ictx"), lambda x: F.when(x["dctx"] == x["ictx"], F.lit("1")).otherwise(F.lit("0"))), "").alias("same"))
    left = F.length(F.regexp_extract(F.substring("same", 1, SIDE), "(1*)$", 1))
    right = F.length(F.regexp_extract(F.substring("same", SIDE + 1, WINDOW), "^(1*)", 1))
    d = d.withColumn("left", F.when(F.col("need") < WINDOW, 0).otherwise(left)).withColumn("right", F.when(F.col("need") < WINDOW, F.least("need", right)).otherwise(right))
    true_run = (F.col("right") >= F.least(F.lit(K), F.col("need"))) & (F.col("left") + F.col("right") >= F.col("need"))
    d = d.withColumn("run", F.when(true_run, F.struct((F.col("p") - F.col("left")).alias("first"), (F.col("p") + F.col("right") - 1).alias("last"))))
    d = d.withColumn("items", F.when(F.col("run").isNotNull(), F.col("items")))
    by = d.groupBy("id", "th", "n_words").agg(
        F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set("run")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # runs are sorted by their first word, so each adds what lies beyond the last word seen
    hit = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(
            F.greatest(s["to"], r["last"]).alias("to"),
            (s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"] - 1, s["to"])).cast("long")).alias("n"),
        ),
        lambda s: s["n"],
    )
    out = by.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("runs").alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
