"""Secret scans: candidates by a pattern, false positives removed by a random forest written as Spark expressions.

A candidate is a run of 16 characters or more of keys and tokens, with dots inside, or a value of 4 or more that follows
a sign of assignment; neither has a greatest length. Its features are its length, its
kinds of characters and the changes between them, how much of it dictionary words cover, whether it looks like part of
a path, and the words next to it. The forest is trained on labelled findings, a bounded table, in the driver; its trees
become nested conditional expressions, so every candidate of every text is judged inside the projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import let

#: What an assignment with quotes holds, what one without holds (addresses aside), and runs anywhere.
CANDIDATE = "|".join([
    r"""(?<=["'`])(?<=[:=]\s{0,4}["'`])[^\s"'`]{4,}""",
    r"""(?<=[:=]\s{0,4})(?!(?<=:)//)[^\s"'`<>,;&=:]{4,}(?:={1,2}(?![A-Za-z0-9+/_=."'`\-]))?""",
    r"""(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9+/_\-](?:={1,2}(?![A-Za-z0-9+/_=."'`\-]))?""",
])
BEFORE, AFTER = 48, 24
#: Words that make a value look like an identifier or a placeholder.
DICTIONARY = (
    "example sample test dummy changeme placeholder your here image photo thumb static assets upload file data user name "
    "page index version release build class module package object value field item list table column query session "
    "default config option param commit branch master github http https html json style script font icon button"
).split()
#: Words that speak for a secret nearby, and for something else.
FOR, AGAINST = "token secret password passwd pwd apikey api_key access_key auth bearer credential private".split(), "sha1 sha256 md5 checksum digest etag commit revision uuid guid order invoice isbn phone card tracking".split()
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "longest_letters", "hex", "covered", "slashes",
    "path_before", "dashes", "assigned", "quoted", "word_for", "word_against", "repeats",
]
LABELLED_ROWS = 6000


def features(value: Column, before: Column, after: Column) -> Column:
    """The struct of FEATURES of a candidate and the text on both sides of it, as doubles."""
    n = F.length(value).cast("double")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    low = F.lower(value)
    near = F.lower(F.concat(F.regexp_extract(before, r"([^\n]*)$", 1), F.lit(" "), F.regexp_extract(after, r"^([^\n]*)", 1)))
    letters = F.regexp_extract_all(value, F.lit(r"([A-Za-z]+)"), 1)
    out = {
        "length": n,
        "digits": count("[0-9]"),
        "uppers": count("[A-Z]"),
        "lowers": count("[a-z]"),
        "others": count("[^A-Za-z0-9]"),
        "changes": F.regexp_count(value, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(36.0)),
        "longest_letters": F.coalesce(F.array_max(F.transform(letters, lambda x: F.length(x))), F.lit(0)) / n,
        "hex": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & value.rlike("[A-Fa-f]")),
        "covered": 1.0 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / n,
        "slashes": count("/"),
        "path_before": flag(before.rlike(r"[/\\.?&]$|https?:[^\s]*$") | after.rlike(r"^[/\\]|^\.[a-z]{2,4}\b")),
        "dashes": count("-"),
        "assigned": flag(before.rlike(r"[=:]\s{0,2}[\"'`]?$|[Bb]earer\s$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "word_for": flag(near.rlike("|".join(FOR))),
        "word_against": flag(near.rlike("|".join(rf"\b{w}" for w in AGAINST))),
        "repeats": F.regexp_count(value, F.lit(r"(.)\1\1")) / n,
    }
    return F.struct(*[out[f].cast("double").alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """(value, before, after, secret): made-up findings of the usual kinds, the same each time.

    Real labelled findings of the same columns can be given to scan() in their place.
    """
    i = F.col("id")
    hexes = lambda salt, n: F.substring(F.concat(F.md5(F.concat(F.lit(salt), i)), F.md5(F.concat(F.lit(salt + "b"), i))), 1, n)
    base = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.encode(F.concat(F.md5(F.concat(F.lit(salt), i)), F.md5(F.concat(F.lit(salt + "c"), i))), "UTF-8")), "[A-Za-z]{2}", ""), 1, n)
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(F.md5(F.concat(F.lit("m"), i)), F.md5(F.concat(F.lit("n"), i))))), "=", "")
    pick = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(options)).cast("long")) + 1).cast("int"))
    names = pick(["token = ", "secret: ", "password=", "api_key = ", "access_key: ", "auth_token=", "client secret = ", "private key: "], 1)
    prose = pick(["the ", "and see ", "of which ", "as in ", "value ", "with id ", "und der ", "de la "], 2)
    quote = pick(['"', "'", ""], 3)
    number = lambda k, n: F.substring(F.regexp_replace(F.concat(F.sha2(F.concat(F.lit(k), i), 256), F.sha2(F.concat(F.lit(k + "z"), i), 256)), "[a-f]", ""), 1, n)
    word = lambda k: F.concat(pick("ver lich keit ment tion sch ein ander hunter river stone green".split(), k), pick("heit ung and er ing ado ous able en".split(), k + 100))
    kinds = [  # value, before, after, secret
        (hexes("a", 40), F.concat(names, quote), quote, 1), (hexes("b", 32), F.concat(names, quote), quote, 1), (mixed, F.concat(names, quote), quote, 1),
        (F.concat(F.lit("key_live_"), F.substring(mixed, 1, 24)), F.concat(prose, quote), quote, 1), (mixed, F.lit("Authorization: Bearer "), F.lit(" "), 1), (hexes("c", 64), F.concat(names, quote), quote, 1),
        (hexes("d", 40), pick(["commit ", "revision: ", "sha1 "], 4), F.lit(" "), 0), (hexes("e", 64), pick(["sha256:", "checksum = ", "digest: "], 5), F.lit("\n"), 0), (number("f", 16), prose, F.lit(" "), 0),
        (F.concat(F.lit("user_profile_page_"), number("g", 3)), F.concat(prose, quote), quote, 0), (F.concat(F.lit("your_token_here_"), number("h", 4)), F.concat(names, quote), quote, 0),
        (F.concat(F.lit("images/thumb/"), number("i", 12)), F.lit("https://www.example.com/"), F.lit(".png"), 0), (F.concat_ws("-", hexes("j", 8), hexes("k", 4), hexes("l", 4), hexes("o", 12)), pick(["uuid: ", "guid=", "order "], 6), F.lit(" "), 0),
        (F.concat(F.lit("xxxxxxxxxxxxxxxx"), number("p", 2)), F.concat(names, quote), quote, 0), (F.concat(number("q", 4), F.lit("-"), number("r", 4), F.lit("-"), number("s", 4), F.lit("-"), number("t", 4)), pick(["card ", "phone: ", "call ", "on "], 7), F.lit(" "), 0),
        (F.concat(F.lit("release-version-build-"), number("u", 6)), prose, F.lit(" "), 0),
        # tokens with dots, long ones, ones without digits, short passwords
        (F.concat(F.lit("eyJ"), mixed, F.lit(".eyJ"), mixed, F.lit("."), F.reverse(mixed)), F.concat(names, quote), quote, 1), (F.concat(F.lit("eyJ"), mixed, F.lit(".eyJ"), F.reverse(mixed)), F.lit("Authorization: Bearer "), F.lit(" "), 1),
        (F.repeat(mixed, 9), F.concat(names, quote), quote, 1), (F.substring(F.regexp_replace(mixed, "[^A-Za-z]", ""), 1, 24), F.concat(names, quote), quote, 1),
        (F.concat(word(8), pick(["-", "!", "_", "#", ""], 9), number("v", 2), pick(["-", "x", "$", ""], 10), hexes("w", 3)), F.concat(names, quote), quote, 1),
        # long words, names and addresses with dots, lines of one character, assigned values that are no secrets
        (F.concat(word(11), word(12), word(13), word(14)), prose, pick([" ", ".", ", "], 15), 0), (F.upper(F.concat(word(16), word(17), word(18), word(19))), prose, F.lit(" "), 0),
        (F.concat_ws(".", F.lit("www"), word(20), F.concat(word(21), number("x", 1)), F.lit("com")), prose, F.lit(" "), 0), (F.concat(F.lit("//www."), word(22), F.lit(".com/"), word(23), F.lit("/"), number("y", 12), F.lit(".png")), F.concat(prose, F.lit("https:")), F.lit(" "), 0),
        (F.concat(F.repeat(F.substring(word(24), 1, 1), 200), number("z", 1)), pick(["", "the ", "\n"], 25), F.lit(" "), 0), (word(26), F.concat(names, F.lit("")), F.lit(" "), 0),
        (F.initcap(word(27)), pick(["note: ", "page: ", "class = ", "Subject: ", "x = "], 28), F.lit(" "), 0), (number("A", 5), pick(["size = ", "page: ", "width=", "at 12:", "total: "], 29), F.lit(" "), 0),
        (F.concat(word(30), F.lit("-"), word(31)), F.concat(pick(["class=", "title = ", "name: ", "href="], 32), quote), quote, 0), (word(33), F.concat(names, quote), quote, 0),
    ]
    which = F.pmod(i, F.lit(len(kinds)))
    choose = lambda k: F.element_at(F.array(*[(x[k] if isinstance(x[k], Column) else F.lit(x[k])) for x in kinds]), (which + 1).cast("int"))
    return spark.range(rows).select(choose(0).alias("value"), choose(1).alias("before"), choose(2).alias("after"), choose(3).alias("secret"))


def _tree(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 4):
    """A leaf (share of secrets) or (feature, threshold, below, from it on), by Gini impurity over random features."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if not len(cut):
            continue
        p, q = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(y) - cut)
        bad = cut * p * (1 - p) + (len(y) - cut) * q * (1 - q)
        k = int(bad.argmin())
        if best is None or bad[k] < best[0]:
            best = (bad[k], int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, t = best
    left = x[:, f] < t
    return f, t, _tree(x[left], y[left], depth - 1, rng, least), _tree(x[~left], y[~left], depth - 1, rng, least)


def train_forest(rows: list[tuple[list[float], int]], trees: int = 24, depth: int = 7, seed: int = 11) -> list:
    """Trees over bootstrap samples of (features, label) rows, which are sorted first: the same rows give the same forest."""
    if not rows:
        return [0.0]
    rows = sorted(rows)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        some = rng.integers(0, len(y), len(y))
        out.append(_tree(x[some], y[some], depth, rng))
    return out


def forest_column(forest: list, f: Column) -> Column:
    """The mean of the trees as nested conditional expressions over the struct of features."""
    def walk(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(f[FEATURES[t[0]]] < F.lit(t[1]), walk(t[2])).otherwise(walk(t[3]))

    total = F.lit(0.0)
    for t in forest:
        total = total + walk(t)
    return total / F.lit(float(len(forest)))


def predict(forest: list, x: list[float]) -> float:
    """The same outside Spark."""
    def walk(t):
        return t if isinstance(t, float) else walk(t[2] if x[t[0]] < t[1] else t[3])

    return sum(map(walk, forest)) / len(forest)


def learn(labelled: DataFrame, rows: int = LABELLED_ROWS) -> list:
    """A forest from at most ``rows`` labelled findings, those with the smallest hash; null values or labels are left out."""
    known = labelled.filter(F.col("value").isNotNull() & F.col("secret").isNotNull() & (F.length("value") > 0))
    known = known.orderBy(F.xxhash64("value", "before", "after")).limit(rows)
    got = known.select(features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))).alias("f"), F.col("secret").cast("int").alias("y")).collect()
    return train_forest([([float(v) for v in r["f"]], r["y"]) for r in got])


def _findings(text: Column) -> Column:
    """An array of the distinct candidates: value, start, occurrences, and the distinct contexts (before, after).

    Candidates and what stands between them alternate in ``pieces``; no lookup of a value in the text is needed.
    """
    def distinct(values: Column, pieces: Column, ends: Column) -> Column:
        def context(k: Column) -> Column:
            # a candidate has four characters at least, so that 24 pieces before it and 12 after it are enough
            first = F.greatest(F.lit(1), 2 * k - 23)
            before = F.substring(F.array_join(F.slice(ends, first, 2 * k + 2 - first), ""), -BEFORE, BEFORE)
            return F.struct(before.alias("before"), F.substring(F.array_join(F.slice(ends, 2 * k + 3, 13), ""), 1, AFTER).alias("after"))

        def finding(v: Column) -> Column:
            at = F.filter(F.transform(values, lambda x, k: F.when(x == v, k)), lambda k: k.isNotNull())
            return let(at, lambda at: F.struct(
                v.alias("value"),
                F.aggregate(F.slice(pieces, 1, 2 * at[0] + 1), F.lit(1), lambda s, x: s + F.length(x)).alias("start"),
                F.size(at).alias("occurrences"),
                F.array_distinct(F.transform(at, context)).alias("contexts"),
            ))

        return F.transform(F.array_distinct(values), finding)

    cut = lambda x: F.when(F.length(x) > BEFORE + AFTER, F.concat(F.substring(x, 1, AFTER), F.substring(x, -BEFORE, BEFORE))).otherwise(x)
    pieces = lambda values: F.flatten(F.zip_with(F.split(text, CANDIDATE, -1), values, lambda g, v: F.array(g, v)))
    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), lambda v: let(pieces(v), lambda p: let(F.transform(p, cut), lambda e: distinct(v, p, e))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, value, start, occurrences, contexts): the distinct candidates of each row's whole text.

    start is the place, from 1, of the first occurrence; contexts has what stands before and after any of them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = found.select("id", F.explode_outer(_findings(F.col("text"))).alias("x")).filter(F.col("x").isNotNull())
    return found.select("id", "x.value", "x.start", "x.occurrences", "x.contexts")


def scan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Findings of docs: id, value, start, length, occurrences, value_sha256, probability and secret.

    Each occurrence is judged by what stands around it; the value has the largest probability of them.
    Null and empty texts have no findings, nor has an empty table. Repeated rows each give their findings. Without
    labelled findings nothing is a secret. Other columns of docs are ignored, whatever their names.
    """
    forest = learn(labelled)
    judged = lambda c: let(features(F.col("value"), c["before"], c["after"]), lambda f: forest_column(forest, f))
    found = candidates(docs, id_col, text_col).withColumn("probability", F.round(F.array_max(F.transform("contexts", judged)), 6))
    return found.select(
        F.col("id").alias(id_col), "value", F.col("start").cast("int").alias("start"), F.length("value").alias("length"), F.col("occurrences").cast("int").alias("occurrences"),
        F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= threshold).alias("secret"),
    )
