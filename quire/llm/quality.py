"""Quality rules learned from labels: an ordered list of threshold conjunctions, applied as one Spark expression.

Statistics of each text come from DataFrame functions. Sequential covering then learns, from a bounded sample of
labelled texts, rules for the texts to drop: a rule grows by the condition with the best FOIL gain on two thirds of the
rows, is pruned from its end while that does not lower (p - n) / (p + n) on the last third, and is kept if it is precise
there; the rows that it covers go, and the next rule is learned. The list becomes ``CASE WHEN rule THEN drop ... ELSE
keep``, and runs over every text inside the same projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SHINGLE = 5
FEATURES = ["n_words", "mean_word", "symbol_share", "bang_share", "upper_share", "distinct_share", "repeat_share", "dup_line_share", "line_words"]


def words(text: Column) -> Column:
    """The runs of characters that are not white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def _none(kind: str = "long") -> Column:
    return F.array().cast(f"array<{kind}>")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _s: a struct of the counted statistics and the features built from them.

    Repeated words: with g the hashes of the 5-word windows, a text whose g has no value twice has none. Only for the
    others are (hash, position) pairs sorted; equal neighbours give the repeated windows, and the words they cover are
    counted by their sorted positions, five or the way to the next window each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_ws", words(F.col(text_col)))
    d = d.withColumn("_g", F.when(F.size("_ws") >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size("_ws") - SHINGLE), lambda i: F.xxhash64(*[F.get("_ws", i + j) for j in range(SHINGLE)]))).otherwise(_none()))
    d = d.withColumn("_more", F.size("_g") != F.size(F.array_distinct("_g")))
    d = d.withColumn("_gp", F.when(F.col("_more"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_at", F.when(F.col("_more"), F.sort_array(F.transform(
        F.filter("_gp", lambda x, k: F.coalesce(F.get("_gp", k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_gp", k - 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform(F.col("_at"), lambda i, k: F.least(F.lit(SHINGLE), F.coalesce(F.get("_at", k + 1) - i, F.lit(SHINGLE)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    n = F.size("_ws").cast("long")
    d = d.withColumn("_c", F.struct(
        n.alias("n_words"),
        F.char_length(F.array_join("_ws", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_more"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_ws")).cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit("[!]")).cast("long").alias("n_bangs"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    ))
    c = F.col("_c")
    share = lambda a, b: (c[a] / F.greatest(c[b], F.lit(1))).cast("double")
    return d.withColumn("_s", F.struct(
        "_c.*",
        F.struct(
            c["n_words"].cast("double").alias("n_words"),
            share("word_chars", "n_words").alias("mean_word"),
            share("n_symbols", "n_words").alias("symbol_share"),
            share("n_bangs", "n_words").alias("bang_share"),
            share("n_upper", "word_chars").alias("upper_share"),
            share("n_distinct", "n_words").alias("distinct_share"),
            share("n_repeat_words", "n_words").alias("repeat_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"),
            share("n_words", "n_lines").alias("line_words"),
        ).alias("f"),
    )).drop("_ws", "_g", "_more", "_gp", "_at", "_lines", "_c")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self, f: Column) -> Column:
        return f[self.feature] >= F.lit(self.threshold) if self.above else f[self.feature] < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _cuts(rows: list[dict], bins: int) -> dict[str, list[float]]:
    out = {}
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        out[f] = sorted({values[len(values) * k // bins] for k in range(1, bins)} - {values[0]})
    return out


def _grow(rows: list[dict], cuts: dict[str, list[float]], most: int = 4) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        p, n = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not n or not p:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for f in FEATURES:
            at = cuts[f]
            pos, neg = [0] * (len(at) + 1), [0] * (len(at) + 1)
            for r in rows:
                lo, hi, v = 0, len(at), r[f]
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if at[mid] <= v else (lo, mid)
                (pos if r["bad"] else neg)[lo] += 1
            below_p = below_n = 0
            for k, t in enumerate(at):
                below_p, below_n = below_p + pos[k], below_n + neg[k]
                for above, q, m in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                    if q and (gain := q * (math.log2(q / (q + m)) - base)) > best[0]:
                        best = (gain, Condition(f, above, t))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = [r for r in rows if best[1].holds(r)]
    return rule


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int, int]:
    hit = [r["bad"] for r in rows if _covers(rule, r)]
    p = sum(hit)
    return ((2 * p - len(hit)) / len(hit) if hit else -1.0), p, len(hit) - p


def learn_rules(rows: list[dict], precision: float = 0.9, least: int = 3, most: int = 12, bins: int = 64) -> list[Rule]:
    """Rules for rows with ``bad``; rows: dicts of FEATURES, bad (bool) and part (2: for pruning).

    A rule is kept if, on the pruning part, at least ``precision`` of the rows that it covers are bad and it covers
    ``least``; learning ends with the first rule that fails, or without bad rows. No rows: no rules.
    """
    grow, prune = [r for r in rows if r["part"] != 2], [r for r in rows if r["part"] == 2]
    rules: list[Rule] = []
    if not grow or not prune:
        return rules
    cuts = _cuts(grow, bins)
    while len(rules) < most and any(r["bad"] for r in grow):
        rule = _grow(grow, cuts)
        while len(rule) > 1 and _worth(rule[:-1], prune)[0] >= _worth(rule, prune)[0]:
            rule = rule[:-1]
        _, p, n = _worth(rule, prune)
        if not rule or p < least or p < precision * (p + n):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _covers(rule, r)] for part in (grow, prune))
    return rules


def decision(rules: list[Rule], f: Column) -> Column:
    """Which rule drops the row (from 1), null if none: the ordered list as one conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column(f)
        for c in rule[1:]:
            cond = cond & c.column(f)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[dict]:
    """Features of about ``rows`` labelled texts, at most twice that: those with the smallest hash of the id.

    The fraction follows from the count of the labelled ids, so that the sample does not depend on partitions. Null labels
    and ids are left out. An id is one row whatever repeats it: of its labels the smallest counts, of its texts the one
    with the least hash; so no more than 2 * rows rows reach the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    some = known.filter(place < F.lit(int(share * (1 << 30)))).orderBy(place, "_id").limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    texts = texts.groupBy("_id").agg(F.first("_label").alias("_label"), F.min_by("_text", F.coalesce(F.xxhash64("_text"), F.lit(0))).alias("_text"))
    got = statistics(texts, "_text").select("_id", "_label", "_s.f").collect()
    return [{**r["f"].asDict(), "bad": r["_label"] == 0, "part": _part(r["_id"])} for r in sorted(got, key=lambda r: str(r["_id"]))]


def _part(value: object) -> int:
    import zlib

    return zlib.crc32(f"part {value}".encode()) % 3


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, the statistics, base_failed, kept and rule (the one that dropped it, else null).

    A null or empty text has no words, so it fails the base rule. Repeated rows each keep a row, an empty table gives
    none; other columns of docs are ignored, whatever their names.
    """
    d = statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    s = F.col("_s")
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    d = d.withColumn("rule", decision(rules, s["f"]))
    return d.select(
        F.col("_id").alias(id_col), s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
        s["n_dup_lines"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"), "rule",
    )


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 9000, **columns: str) -> DataFrame:
    """Learn from at most 2 * sample_rows labelled rows, apply to all rows of docs."""
    rules = learn_rules(labelled_sample(docs, labels, sample_rows, **columns))
    return apply_rules(docs, rules, **{k: v for k, v in columns.items() if k != "label_col"})
