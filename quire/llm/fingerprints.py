"""Document fingerprints: the k least hashes of a text's shingles, from which likeness is estimated and parts are merged.

A shingle is five words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case); a text of fewer words is one shingle, one without
words has none. A sketch is the sorted array of the k least distinct 64-bit hashes. The sketch of several parts is the
bottom k of their sketches' union, so sketches of anything can be merged in any order. All of it is DataFrame functions.

Likeness is estimated on the bottom k of the union of two sketches: of these, the share that both hold. With k = 256 the
standard error is at most 0.031; texts of up to k distinct shingles are compared exactly when their union has no more.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._native import ascii_lower, let

K, SHINGLE = 256, 5
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a range of ids, and ranges at most; ranges are found by looking through three levels of FAN bounds.
RANGE_ROWS, FAN, LEVELS = 4096, 64, 3
_LEAST = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(text: Column) -> Column:
    """A hash for each run of SHINGLE words, or one of all the words where there are fewer."""
    def hashes(ws: Column) -> Column:
        # xxhash64 passes over nulls, so the words of a short text are hashed as one shingle
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(ws) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), hashes)


def least(hashes: Column, k: int = K) -> Column:
    """The sketch of some hashes: the k least, each once, sorted."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return least(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches were made of, together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact where the sketch is not full, else (k - 1) / the k-th hash's place in 0..1."""
    place = (F.get(s, F.lit(k - 1)).cast("double") - float(_LEAST)) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.greatest(place, F.lit(2.0**-64)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of shared shingles (intersection by union), 0 to 1; two texts without shingles are alike."""
    union = merge(a, b, k)
    shared = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared.cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too, 0 to 1; a text without shingles is contained in any."""
    n, m = distinct_count(a, k), distinct_count(b, k)
    part = let(resemblance(a, b, k), lambda r: r * (n + m) / (1 + r) / n)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(part, F.lit(1.0)))


def encode(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def decode(text: Column) -> Column:
    """The sketch of an encoded one."""
    def number(i: Column) -> Column:
        half = lambda at: F.conv(F.substring(text, i * 16 + at, F.lit(8)), 16, 10).cast("long")
        return F.shiftleft(half(1), 32).bitwiseOR(half(9))

    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), (F.length(text) / 16 - 1).cast("int")), number)).when(text == "", F.array().cast("array<bigint>"))


def merged(df: DataFrame, by: list[str], sketch_col: str, k: int = K, name: str = "sketch") -> DataFrame:
    """One merged sketch for each value of the columns ``by``: of a source, a day, a whole corpus ([]).

    Every task keeps the k least hashes of a value before the shuffle (a rank limit that Spark applies on both sides),
    so a value with a third of all rows is no larger than any other. Null sketches add nothing; a value that has no
    hash at all is there with an empty sketch.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    each = df.select(*keys, F.explode_outer(sketch_col).alias("_h")).groupBy(*names, "_h").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*names).orderBy(F.col("_h").asc_nulls_last())
    low = each.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    out = low.groupBy(*names).agg(F.sort_array(F.collect_list("_h")).alias(name))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], name)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row of docs: id, n_shingles (estimated), sketch. Null and empty texts have an empty sketch."""
    s = docs.select(F.col(id_col).alias("id"), sketch(F.col(text_col), k).alias("sketch"))
    return s.select(F.col("id").alias(id_col), F.round(distinct_count(F.col("sketch"), k)).cast("long").alias("n_shingles"), "sketch")


# ------------------------------------------------------------------------------------------- next documents
def _levels(bounds: list, fan: int) -> list[list]:
    """Bounds as a tree: the last list has them all, each list before it the first of every ``fan`` of the next."""
    levels = [bounds]
    while len(levels[0]) > fan:
        levels.insert(0, levels[0][::fan])
    return levels


def _range_of(spot: Column, bounds: list[dict], kind: str, fan: int = FAN) -> Column:
    """The index of the last bound that is not beyond spot, level by level, ``fan`` comparisons each."""
    at = F.lit(0)
    for level in _levels(bounds, fan):
        groups = F.from_json(F.lit(json.dumps([level[i : i + fan] for i in range(0, len(level), fan)])), f"array<array<{kind}>>")
        at = let(at, lambda a, groups=groups: a * fan + F.size(F.filter(F.get(groups, a), lambda b: b <= spot)) - 1)
    return at


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, text, copies, spot, range, extra): rows by range of ids, each range followed by an extra row, the next range's first.

    Rows are ordered by id, nulls first, then by a hash of the text, then by the text; rows equal in id and text are one
    row with their number as copies. Bounds of ranges come from a pass over ids and hashes alone, and whether rows
    repeat from counting these; texts are moved once. A range's first row is also sent to the range before it (the first
    of all to the last), so what follows a row is found without any global sort or single task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spot = F.struct(F.col("id").alias("i"), F.xxhash64("text").alias("h"))
    spots = rows.select(spot.alias("spot"))
    seen = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    if (seen["most"] or 0) > 1:
        rows = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(FAN**LEVELS, seen["n"], max(seen["n"] // range_rows, 4 * tasks)))
    least_of = spots.repartitionByRange(ranges, "spot").groupBy(F.spark_partition_id().alias("p")).agg(F.min("spot").alias("spot"))
    bounds = sorted((r["spot"] for r in least_of.collect()), key=lambda s: (s["i"] is not None, s["i"], s["h"]))  # one row a range
    bounds = [{"i": s["i"], "h": s["h"]} for s in bounds] or [{"i": None, "h": 0}]
    kind = f"struct<i:{rows.schema['id'].dataType.simpleString()},h:bigint>"
    placed = rows.withColumn("spot", spot).withColumn("range", _range_of(F.col("spot"), bounds, kind))
    # a row that equals a bound is the first of its range; it comes twice
    starts = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
    last = len(bounds) - 1
    before = F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1)
    both = F.when(F.get(starts, F.col("range")) == F.col("spot"), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(before.alias("range"), F.lit(True).alias("extra"))))
    both = both.otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra"))))
    return placed.withColumn("at", F.explode(both)).select("id", "text", "copies", "spot", "at.range", "at.extra")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is overwritten by the next document's start.

    Per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles
    (estimated) and edited_contained (share of its shingles that the edited text keeps). A null text is empty. The next
    document is the next of the order in ``with_next``, after the last the first; the only document is its own next.
    Rows equal in id and text are one document, and each gets its result. Empty tables give no rows; other columns are
    ignored, whatever their names. Texts without words are alike (1) and unlike all others (0).
    """
    parts = with_next(docs, id_col, text_col, range_rows)
    w = Window.partitionBy("range").orderBy("extra", "spot", "text")
    # the extra row may be one of several with a bound's id and hash; the first of them sorts first by its text
    # sketches are made behind the first window, so that the shuffle carries texts alone
    d = parts.withColumn("next_text", F.lead("text").over(w)).withColumn("s", sketch(F.col("text"), k))
    d = d.withColumn("next_s", F.lead("s").over(w)).filter(~F.col("extra"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    d = d.withColumn("e", sketch(F.col("edited"), k))
    d = d.select(
        F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), encode(F.col("s")).alias("fingerprint"), encode(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("next_s"), k).alias("near_next"),
        F.round(distinct_count(F.col("s"), k)).cast("long").alias("n_shingles"), containment(F.col("s"), F.col("e"), k).alias("edited_contained"), "copies")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")
