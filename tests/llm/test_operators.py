"""Small fixtures against brute-force versions: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, language, lines, mixing, pieces, quality, secrets, sharding, warc
from quire.llm._components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = language.DEFAULT_VOCABULARY
SCHEMA = "doc_id long, text string, lang string, component_id string, words string"


def frame(spark, texts):
    """Documents 0.. with extra columns whose names clash with those of operators."""
    return spark.createDataFrame([(k, t, None if t is None else "en", "x", "y") for k, t in enumerate(texts)], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- decontamination
def contaminated(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, text in items:
            q = split(text)
            m = min(13, len(q))
            wins = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)} if q else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination_equals_brute_force(spark, broadcast_rows):
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 13, 12, 6, 5, 4, 1, 30])] + [(20, None), (21, ""), (22, "..."), (23, "a a a a a a a a a a a a a a a a a a"), (9, "É Ü straße " * 6)]
    item = dict(items)
    texts = [None, "", "?!", item[0], item[0].upper() + " " + item[1], prose(rng, 20) + " " + item[0][10:160] + " " + prose(rng, 300), "a " * 40, item[9] + " x " + item[3], item[5] + " " + item[6], prose(rng, 3000) + " " + item[7], item[2] + "." + item[2], "É ü straße " * 6]
    got = decontamination.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == contaminated(texts, items)


def test_decontamination_repeats_and_empty(spark):
    docs = frame(spark, ["a b c", "x"])
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontamination.contamination(docs.union(docs), bench).count() == 4
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}


# ---------------------------------------------------------------- archives
def test_archives_round_trip(spark):
    page = "<p>" + "long text " * 30 + "</p>"
    rows = [(5, "http://a/", page), (3, None, page), (9, "http://b/x y", page + "é"), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (2, "u\r\nx", page)]
    back = {int(r["page_id"]): r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert len(back) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        assert back[k]["payload_bytes"] == len(data) and back[k]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert {k: r["refers_to"] for k, r in back.items() if r["record_type"] == "revisit"} == {5: "2", 3: "2"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_archive_bytes():
    records = [warc.record(k, "u", b"payload %d " % k * 40, hashlib.sha256(b"payload %d " % k * 40).hexdigest()) for k in range(50)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(data[4:8], "little") > 0
    assert list(warc.frames(data)) == records
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    for bad in (records[0][:-1], records[0].replace(b"payload 0 ", b"payload 1 ", 1), records[0].replace(b"Content-Length: 4", b"Content-Length: 5", 1), b"no record"):
        with pytest.raises(ValueError):
            warc.parse(bad)


# ---------------------------------------------------------------- language
def test_language_learns_and_answers(spark):
    rng = random.Random(2)
    words = {"en": "the of and to in is that it was for with".split(), "de": "der die das und ist nicht ein zu von mit".split()}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(30)), x) for k in range(60) for x in [("en", "de")[k % 2]]]
    rows += [(100, None, "en"), (101, "123 !?", "de"), (102, "", None), (103, "Und das ist " + "x" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.identify(docs, docs.filter("doc_id < 40"), vocabulary_path=MODEL).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x in rows[40:60]) and got[103]["lang_pred"] == "de"
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, docs.limit(0), vocabulary_path=MODEL).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    lattice = language.Lattice(["▁", "a", "b", "ab", "▁a", "▁ab"])
    p = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2], [1e-6]])
    want = 0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.05 * 0.3 + 0.2
    assert math.isclose(float(np.exp(lattice.log_probabilities(["ab"], p))[0, 0]), want)


def segmentations(word, index):
    """Every way to cut a word into pieces, or characters of no piece, as lists of piece numbers."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        i = index.get(word[:k], len(index) if k == 1 else None)
        if i is not None:
            for rest in segmentations(word[k:], index):
                yield [i, *rest]


def test_forward_and_expected_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    pieces_ = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "éa"]
    lattice, table = language.Lattice(pieces_), rng.uniform(0.01, 0.3, (11, 3))
    words = ["ab", "a", "abab", "abba", "éab", "日", "ababbaab", "bé"]
    counts = rng.uniform(0, 5, (len(words), 3))
    want, total = np.zeros_like(table), np.zeros((len(words), 3))
    for w, word in enumerate(words):
        ways = list(segmentations("▁" + word, lattice.index))
        p = np.array([table[x].prod(axis=0) for x in ways])
        total[w] = p.sum(axis=0)
        for x, share in zip(ways, p / total[w], strict=True):
            for i in x:
                want[i] += counts[w] * share
    assert np.allclose(np.exp(lattice.log_probabilities(words, table)), total, rtol=1e-9)
    assert np.allclose(lattice.expected(words, counts, table), want, rtol=1e-9)
    # long words take logarithms; both ways agree
    for long_ in ("ab" * 19, "abba日" * 7):
        both = [lattice._long_forward(lattice._long_arcs(long_), np.log(table))[-1], lattice.log_probabilities([long_], table)[0]]
        assert np.allclose(*both, rtol=1e-9)
    keep, language.WIDEST = language.WIDEST, 3
    try:
        assert np.allclose(lattice.expected(words, counts, table), want, rtol=1e-9)
    finally:
        language.WIDEST = keep


def test_predictions_equal_brute_force(spark):
    import numpy as np

    texts = [("ab ab ba", "x"), ("ab aab", "x"), ("bb ba bbb", "y"), ("b bb", "y"), ("abab!", None), ("bbb bab", None), ("a日 b", None)]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    vocabulary = ["▁", "a", "b", "ab", "▁a", "▁b", "bb"]
    langs, table = language.learn(docs, vocabulary)
    index = {p: i for i, p in enumerate(vocabulary)}
    own = np.full((8, 2), 1 / 7)
    own[-1] = language.FLOOR
    for _ in range(2):
        uses = np.zeros((8, 2))
        for t, x in texts:
            for w in language.split_words(t) if x else ():
                ways = list(segmentations("▁" + w, index))
                p = np.array([own[s, "xy".index(x)].prod() for s in ways])
                for s, share in zip(ways, p / p.sum(), strict=True):
                    np.add.at(uses[:, "xy".index(x)], s, share)
        uses[-1] = 0
        prior = uses.sum(axis=1, keepdims=True) + 0.01
        smooth = uses + 4.0 * prior / prior.sum()
        own = smooth / smooth.sum(axis=0)
        own[-1] = language.FLOOR
        own = np.maximum(own, language.FLOOR * 1e-2)
    assert langs == ["x", "y"] and np.allclose(table, own, rtol=1e-9)
    run = language._scorer(vocabulary, langs, table)
    import pyarrow as pa

    got = next(run(iter([pa.record_batch([pa.array([t for t, _ in texts])], ["text"])]))).to_pylist()
    for (t, _), r in zip(texts, got, strict=True):
        logs = sum(np.log(sum(own[s].prod(axis=0) for s in segmentations("▁" + w, index))) for w in language.split_words(t))
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert r["lang_pred"] == langs[int(share.argmax())] and math.isclose(r["score"], share.max(), rel_tol=1e-9)


def test_letters_and_long_words(spark):
    rows = [(0, "the and of", "en"), (1, "der und das", "de"), (2, "² ½ ① Ⅷ 12 _", None), (3, "日本語" * 40, None), (4, "日" * 40, None), (5, "the" * 3000, None), (6, "the and of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs.union(docs), docs).collect()}
    assert got[2] == ("und", 0.0) and got[0][0] == "en" and all(got[k][0] in ("en", "de") and 0 <= got[k][1] <= 1 for k in (0, 1, 3, 4, 5, 6))
    assert language.identify(docs.limit(0), docs).count() == 0
    assert language.identify(docs.union(docs), docs).count() == 14


# ---------------------------------------------------------------- near duplicates
def linked_classes(texts):
    sets = {}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = prose(rng, rng.choice([8, 30, 120, 400]), 10_000).split()
        texts.append(" ".join(base))
        for _ in range(12):
            new = list(base)
            for _ in range(rng.randrange(1, 8)):
                new[rng.randrange(len(new))] = "edit" + str(rng.randrange(10_000))
            texts.append(" ".join(new))
    shared = prose(rng, 60, 10_000)
    texts += [prose(rng, 50, 10_000) + " " + shared for _ in range(15)] + [texts[10]] * 5 + ["z " * 3000]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, texts)).collect()}
    assert got == linked_classes(texts)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_classes(frame(spark, ["x"]).limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


# ---------------------------------------------------------------- pieces
def test_pieces_equal_the_library(spark):
    import sentencepiece

    texts = ["Hello   world.  New\n  lines\n\n", "日本語 тест é", " ", "", None, "a▁b", "   x", "word " * 4000, "\U0001f600" * 5, "TheEnd", "The End"]
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in pieces.encode(frame(spark, texts)).collect()}
    assert [got[k]["ids"] for k in range(len(texts))] == [p.encode(t or "") for t in texts]
    assert [k for k in got if not got[k]["round_trip"]] == [5]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(frame(spark, texts))).collect()}
    assert [back[k] for k in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]


def test_viterbi_finds_the_best_sum():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=MODEL).serialized_model_proto())
    m.trainer_spec.model_type = 1
    for k, x in enumerate(m.pieces):
        if x.type == 1:
            x.score = -4 - math.sqrt(k + 1) / 13  # no two sums alike
    raw = m.SerializeToString()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Model(proto=raw)
    texts = ["the thing things thinking theory shared prefixes prefix pre", "".join(f"word{k}of" for k in range(12)), "日本語 тест é"]
    words = sorted({w for t in texts for w in own.units.findall("▁" + t.replace(" ", "▁"))})
    flat, per = pieces.Encoder(own).encode_sorted(words)[0]
    got = {w: flat[e - n : e].tolist() for w, e, n in zip(words, per.cumsum(), per, strict=True)}
    for t in texts:
        assert [i for w in own.units.findall("▁" + t.replace(" ", "▁")) for i in got[w]] == lib.encode(t)


def test_best_sums_equal_all_segmentations(spark):
    """The second ids of the BPE model: the largest sum over every way to cut a word."""
    texts = ["theory of shared prefixes", "an aaaa bookkeeper", "  two marks", "日本 é\nx"]
    code = pieces.encoder(MODEL)

    def best(unit):
        value = {0: (0.0, [])}
        for e in range(1, len(unit) + 1):
            options = []
            for s in range(e):
                i = code.m.id.get(unit[s:e])
                if i is not None or e - s == 1:
                    gain = code.m.viterbi[i] if i is not None else code.m.unknown_score
                    options.append((value[s][0] + gain, value[s][1] + ([i] if i is not None else code.m.character(unit[s:e]))))
            value[e] = max(options, key=lambda x: x[0])
        return value[len(unit)][1]

    got = {r["doc_id"]: r for r in pieces.encode(frame(spark, texts), best=True).collect()}
    for k, t in enumerate(texts):
        assert got[k]["best_ids"] == [i for u in code.m.units.findall("▁" + t.replace(" ", "▁")) for i in best(u)]
        assert got[k]["round_trip"]


def test_long_runs_of_one_character(spark):
    import sentencepiece

    texts = [" " * 30_000, "a" * 20_000, "  " + "ab" * 5000, "=" * 777]
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [p.encode(t) for t in texts]


def test_pieces_empty_and_repeated(spark):
    docs = frame(spark, ["a b", None])
    assert pieces.encode(docs.limit(0), best=True).count() == 0
    assert sorted(r["n_pieces"] for r in pieces.encode(docs.union(docs)).collect()) == [0, 0, 2, 2]


# ---------------------------------------------------------------- secrets
def test_secrets(spark):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"
    texts = [f'x token = "{key}" y', None, "", "a" * 300 + "1", f"commit {key} and {key}", f'password="{key}"\n' * 3, "see https://www.example.com/images/thumb/12345678901234.png here"]
    got = secrets.scan(frame(spark, texts), secrets.labelled_findings(spark, 2000)).collect()
    assert {r["doc_id"] for r in got if r["secret"]} == {0, 5}
    assert {(r["doc_id"], r["occurrences"], r["start"]) for r in got} >= {(0, 1, 12), (4, 2, 8), (5, 3, 11)}


def test_forest_on_held_out_findings(spark):
    rows = secrets.labelled_findings(spark, 3000).select(secrets.features(F.col("value"), F.col("before"), F.col("after")).alias("f"), "secret").collect()
    data = [([float(v) for v in r["f"]], r["secret"]) for r in rows]
    forest = secrets.train_forest(data[:2000])
    right = sum((secrets.predict(forest, x) >= 0.5) == (y == 1) for x, y in data[2000:])
    assert right >= 0.97 * 1000
    assert secrets.train_forest([]) == [0.0]


# ---------------------------------------------------------------- scoring
def test_scores(spark):
    rng = random.Random(6)
    texts = [prose(rng, 40, 60) for _ in range(60)] + [None, "", "New words HERE", "w1 w1 w1", "q" * 200]
    held = [k % 5 == 0 for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, h boolean")
    got = {r["doc_id"]: r for r in mixing.score_texts(df, "h").collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), None] for t in texts]
    c = Counter(w for k, t in enumerate(tokens) if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(tokens):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / (len((texts[k] or "").encode()) + 1), rel_tol=1e-9)
    assert mixing.score_texts(df.limit(0), "h").count() == 0
    # repeated rows keep a row each, and partitions change nothing
    twice = mixing.score_texts(df.repartition(7).withColumn("score", F.lit("clash")), "h").collect()
    assert {r["doc_id"]: r["score"] for r in twice} == pytest.approx({k: r["score"] for k, r in got.items()}, rel=1e-9)
    assert mixing.score_texts(df.union(df), "h").count() == 2 * len(texts)


def plain_mixture(score, count, tokens, pairs, end):
    """The mixture over a text's words, word by word."""
    logs = {}
    for k, w in enumerate(tokens):
        corpus, prev = 10.0 ** score[w], tokens[k - 1] if k else None
        cache = k / (k + 10)
        again = (1 - end) * tokens[:k].count(w) / max(k, 1)
        before = count[prev] if k else 0
        seen = pairs.get((prev, w), 0) if k else 0
        level = sum(before >= x for x in (1, 8, 64)) if k else 0
        gate = level * 2 + (k > 0 and pairs.get((tokens[k - 2], prev), 0) > 0 and k > 1)
        experts = [corpus] + [(seen * (1 - end) + t * corpus) / (before + t) for t in mixing.TRUST]
        for x, p in enumerate(p2 * (1 - s * cache) + s * cache * again for p2 in experts for s in mixing.SHARES):
            logs.setdefault(gate, [0.0] * 6)[x] += math.log10(p)
    return sum(math.log10(sum(10 ** x for x in v) / 6) for v in logs.values())


def test_mixture_equals_the_plain_one():
    import numpy as np

    rng = random.Random(5)
    texts = [[rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(20)]
    score = np.array([-1.0 - k / 4 for k in range(9)])
    count = np.array([0, 3, 9, 70, 1, 500, 7, 8, 64], float)
    pairs = {(a, b): rng.choice([0, 0, 1, 2]) if count[a] else 0 for a in range(9) for b in range(9)}
    tokens = np.array([w for t in texts for w in t], np.uint32)
    per = np.array(list(map(len, texts)))
    has = np.array([k > 0 for t in texts for k in range(len(t))], bool)
    pair = np.array([pairs[t[k - 1], w] if k else 0 for t in texts for k, w in enumerate(t)], float)
    got = mixing.token_mixture(score, count, tokens, per, pair, has, 0.01)
    assert np.allclose(got, [plain_mixture(score, count, t, pairs, 0.01) for t in texts], rtol=1e-9)


def test_online_learning_equals_the_plain_one():
    """A block's decisions are predicted with the counts before it and the weights so far."""
    import numpy as np

    words = [b"ab", b"abc", b"b"]
    data, length = np.frombuffer(b"".join(words), np.uint8), np.array([2, 3, 1])
    start = np.cumsum(length) - length
    m = mixing.Mixer()
    made = m.learn(mixing.Pieces(data, start, length), np.array([1, 2, 5]))
    assert made == 8 * (3 + 4 + 2)
    weights, counts = mixing.Mixer().weights, np.zeros(2 * mixing.SLOTS)
    for rows, slots, bit, _, place in mixing.Pieces(data, start, length).decisions(0, 3):
        step = np.zeros_like(weights)
        for i in range(len(rows)):
            x = [0.0] * 6 + [0.5]  # nothing is counted yet within the first block
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights[place * 4], strict=True))))
            step[place * 4] += np.array(x) * (bit[i] - p)
        weights = weights + mixing.RATE * step / max(1, math.sqrt(len(rows)))
        for i, r in enumerate(rows):
            for s, o in zip(slots, m.base, strict=True):
                counts[int(bit[i]) * mixing.SLOTS + s[i] + o] += (1, 2, 5)[r]
    assert np.allclose(m.weights, weights) and np.allclose(m.counts, counts)


def test_bits_of_words_sum_to_one():
    """The spelling is a distribution: all one-byte continuations of a context add up to one."""
    import numpy as np

    m = mixing.Mixer()
    m.learn(mixing.Pieces(np.frombuffer(b"someword", np.uint8), np.array([0, 4]), np.array([4, 4])), np.array([3, 1]))
    data = np.arange(256, dtype=np.uint8)
    p = mixing.Pieces(data, np.arange(256), np.ones(256, np.int64))
    logs = np.zeros(256)
    for rows, slots, bit, node, place in p.decisions(0, 256):
        _, _, t = m._mixed(slots, place)
        one = m.probability(t, m._refined(t, node)[0])
        logs[rows] += np.log(np.where(bit == 1, one, 1 - one))
        if place == 7:  # the first byte is done
            break
    assert math.isclose(float(np.exp(logs).sum()), 1.0, rel_tol=1e-9)


# ---------------------------------------------------------------- lines
def line_result(texts):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    spots = defaultdict(list)
    for d, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            if len(x) >= lines.MIN_CHARS:
                spots[x].append((d, k))
    group = {x: x for x in spots}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    names = sorted(spots)
    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                group[find(a)] = find(b)
    classes = defaultdict(list)
    for x in names:
        classes[find(x)] += spots[x]
    return {s for c in classes.values() for s in c if s != min(c)}


@pytest.mark.parametrize("long_list", [64, 4])
def test_lines_equal_brute_force(spark, monkeypatch, long_list):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([19, 20, 21, 40, 90]))) for _ in range(20)]

    def edited(x):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x))
            x = rng.choice((x[:k] + "Z" + x[k:], x[:k] + x[k + 1 :], x[:k] + "Q" + x[k + 1 :]))
        return x

    texts = [None, "", "short\nshort"] + ["\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["counter line number 00000%03d of the table" % k for k in range(30)] + [base[3]] * 4
    monkeypatch.setattr(lines, "LONG_LIST", long_list)
    got = {(r["id"], r["no"]) for r in lines.dropped_lines(frame(spark, texts)).collect()}
    assert got == line_result(texts)
    out = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    for d, t in enumerate(texts):
        parts = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(parts) if (d, k) not in got]
        assert out[d]["text"] == (None if t is None else "\n".join(kept)) and out[d]["n_lines"] == len(parts) and out[d]["n_dropped"] == len(parts) - len(kept)
        assert out[d]["text_crc32"] == zlib.crc32("\n".join(kept).encode())


def test_banded_distance():
    rng = random.Random(9)
    full = line_distance
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        for most in (0, 1, 2, 3):
            assert lines.edit_distance(a, b, most) == min(full(a, b), most + 1)


def line_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# ---------------------------------------------------------------- quality
def base_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_statistics(spark):
    rng = random.Random(10)
    texts = [None, "", "  \n\t ", "a b c d e a b c d e a b c d e", "x " * 500, "é ü\n\né ü\né ü", prose(rng, 300), prose(rng, 400, 3), "#*$%&|<> a\n" * 3, prose(rng, 5000, 5000)]
    got = {r["doc_id"]: r for r in quality.apply_rules(frame(spark, texts), []).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_statistics(t), k
        assert r["kept"] != r["base_failed"]


def test_rules_find_a_planted_concept(spark):
    rng = random.Random(11)
    rows = []
    for k in range(1500):
        row = {f: rng.random() for f in quality.FEATURES} | {"part": k % 3}
        rows.append(row | {"bad": row["symbol_share"] >= 0.8 or row["bang_share"] < 0.2 and row["mean_word"] >= 0.5})
    rules = quality.learn_rules(rows)
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in rules) != r["bad"] for r in rows)
    assert rules and wrong < 0.05 * len(rows)
    assert quality.learn_rules([]) == []
    docs = frame(spark, ["a b"]).limit(0)
    assert quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---------------------------------------------------------------- sharding
@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1000])
def test_shards_are_even_and_slots_gapless(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), "id")).alias("text"), F.lit(1).alias("shard"))
    rows = sharding.shard(df).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        t = "" if r["doc_id"] % 7 == 0 else f"é{r['doc_id']}"
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    if n:
        again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.repartition(3)).collect()}
        assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_repeated_rows_get_slots_of_their_own(spark):
    df = spark.createDataFrame([(1, "a")] * 20 + [(None, None)] * 5, "doc_id long, text string")
    rows = sharding.shard(df).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 25


@pytest.mark.parametrize("n", [1, 2, 17, 1000])
def test_permutation_equals_the_plain_one(spark, n):
    import xxhash

    def mix(value, key, i):
        h = 42
        for x, size in ((value, 8), (key, 8), (i, 4)):
            h = xxhash.xxh64_intdigest(x.to_bytes(size, "little", signed=True), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    got = [r["p"] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 77).alias("p"), "id").orderBy("id").collect()]
    assert sorted(got) == list(range(n)) and got == [sharding.permute_number(x, n, 77, mix) for x in range(n)]


def test_repeated_rows_and_clashing_names(spark):
    """Quality and lines keep every row, whatever other columns are called."""
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, None), (2, "")], "doc_id long, text string").withColumn("n_lines", F.lit(5)).withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == 4 and lines.dedup_lines(docs).count() == 4
    assert lines.dedup_lines(docs.limit(0)).count() == 0
