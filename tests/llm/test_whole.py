"""What operators must not leave out: short lines, rows that share an id, long or dotted secrets, later occurrences."""

import random

import corpus_pipeline
from quire.llm import jaccard, lines, secrets

LONG = "a line that is long enough for edits"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- lines
def test_equal_short_lines_go(spark):
    docs = documents(spark, [(0, "Menu\n\n" + LONG + "\nMenu"), (1, "Menu\n\nMenü\nMenu."), (2, "Menu"), (None, "Menu.\n ")])
    gone = lambda how: {(r["id"], r["no"]) for r in lines.dropped_lines(docs, short=how).collect()}
    assert gone("go") == {(0, 3), (1, 0), (1, 3), (2, 0)}
    assert gone("elsewhere") == {(1, 0), (1, 3), (2, 0)}
    assert gone("stay") == set()


def test_op8_drops_equal_short_lines(spark, tmp_path):
    from quire.llm.queries import QUERIES

    documents(spark, [(0, "Menu\nMenu"), (1, "Menu\n" + LONG)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_dropped"] for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()} == {0: 1, 1: 1}


def test_copies_leave_no_fragments(spark):
    text = LONG + "\nShort one.\n" + LONG[::-1]
    docs = documents(spark, [(0, text), (1, text), (2, text + "\nA new short line"), (3, "Short one.")])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.fresh_lines(spark, docs, "").collect()}
    assert got == {0: text, 2: "A new short line"}


# ---------------------------------------------------------------- rows that share an id
def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in "abcdefg"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[0]), (None, texts[1]), (None, texts[4]), (None, texts[4]), (3, texts[5]), (3, texts[6]), (None, texts[6]), (0, ""), (0, None)]
    once = corpus_pipeline.one_of_each(spark, documents(spark, rows), str(tmp_path))
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (3, texts[5]), (3, texts[6])]
    got = sorted(map(repr, [(r["doc_id"], r["text"]) for r in once.collect()]))
    assert [x for x in got if not x.startswith("(0")] == sorted(map(repr, want))
    spark.createDataFrame([(7, texts[1]), (8, texts[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontaminated(spark, documents(spark, want), str(tmp_path))
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in clean.collect()])) == sorted(map(repr, [w for w in want if w[1] not in texts[1:3]]))


# ---------------------------------------------------------------- secrets
KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"


def test_every_occurrence_is_judged(spark):
    texts = [f"commit {KEY} and\n" + "x " * 100 + f'token = "{KEY}"\n', f"commit {KEY} and\n" * 3, None, ""]
    got = secrets.scan(documents(spark, list(enumerate(texts))), secrets.labelled_findings(spark, 2000)).collect()
    assert [(r["start"], r["occurrences"], r["secret"]) for r in sorted(got, key=lambda r: r["doc_id"]) if r["value"] == KEY] == [(8, 2, True), (8, 3, False)]


def test_long_dotted_and_short_secrets(spark):
    mixed = "AbCdEfGhIjKlMnOpQrStUvWx"
    long_ = "".join(f"{k * 7919 % 999:x}Qz{k * 31 % 97}kR" for k in range(60))
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    values = [long_, mixed, "hunter2-abc", jwt, "hunter2-abc", "aGVsbG8gd29ybGQhIQ7x=="]
    texts = [f'api_key = "{long_}"', f'secret = "{mixed}"', f'password = "{values[2]}"', f"Authorization: Bearer {jwt}", f"password={values[4]}", f"token: {values[5]}"]
    plain = ["the Donaudampfschifffahrt of org.apache.spark.functions.", "Note: see 12:3045 for more", "a" * 3000 + "1", "class = 'navbar'", "https://www.example.com/images/thumb/12345678901234.png"]
    got = secrets.scan(documents(spark, list(enumerate(texts + plain))), secrets.labelled_findings(spark)).filter("secret").collect()
    assert sorted((r["doc_id"], r["value"]) for r in got) == list(enumerate(values))


# ---------------------------------------------------------------- a large family of near copies
def test_family_that_does_not_touch_one_leader(spark):
    """2,000 near copies in a chain: neighbours are linked, far ones share little, so no class leads them all."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts, now = [], list(words)
    for k in range(2000):
        at = rng.randrange(len(now))
        now = now[:at] + [f"x{k}"] + now[at + 1 :]
        texts.append(" ".join(now))
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    assert all(100 * len(x & y) >= 75 * len(x | y) for x, y in zip(sets, sets[1:], strict=False))
    assert not any(all(100 * len(x & y) >= 75 * len(x | y) for y in sets) for x in (sets[0], sets[1000]))
    made = []
    keep = jaccard._verified
    jaccard._verified = lambda sets, pairs, name: made.append(pairs.count()) or keep(sets, pairs, name)
    try:
        got = jaccard.jaccard_classes(documents(spark, list(enumerate(texts)))).collect()
    finally:
        jaccard._verified = keep
    assert len(got) == 2000 and {r["component_id"] for r in got} == {0}
    # far fewer pairs than the links, let alone all pairs
    assert sum(made) < 60_000
