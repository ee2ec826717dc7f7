"""Lists of many lines that share a segment without being near: split, not paired."""

import random
import time

from quire.llm import lines


def brute(texts, most):
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    ordered = sorted(texts)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if lines.edit_distance(a, b, most) <= most:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {t: root(t) for t in texts}


def classes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"] for r in lines.dropped_lines(df).collect()}


def test_families_of_one_segment(spark, monkeypatch):
    monkeypatch.setattr(lines, "LONG_LIST", 4)
    monkeypatch.setattr(lines, "WIDE_LIST", 6)
    rng = random.Random(4)
    letters = "abcdefghij"
    word = lambda n: "".join(rng.choices(letters, k=n))
    common = word(12)
    texts = []
    for k in range(120):
        base = common + word(20) if k % 2 else word(10) + common + word(9)
        texts.append(base)
        if k % 3 == 0:  # a near one by two edits, and one by three
            x = list(base)
            x[-1], x[-3] = "z", "z"
            texts.append("".join(x))
            x[-5] = "z"
            texts.append("".join(x))
        if k % 5 == 0:
            texts.append(base[:25] + base[26:])
    # numbers in a common frame, some near each other
    texts += [f"copyright notice number {n:08d} of the archive" for n in (*range(0, 4000, 97), 12345678, 12345679, 92345670)]
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    of = brute(texts, lines.MAX_EDITS)
    first, want = {}, set()
    for k, t in enumerate(texts):
        if of[t] in first:
            want.add(k)
        first.setdefault(of[t], k)
    assert classes(spark, texts) == want


def test_twenty_thousand_lines_of_a_common_third(spark):
    rng = random.Random(5)
    common = "the same twenty chars"[:20]
    texts = [common + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(20_000)]
    texts += [t[:-1] + "#" for t in texts[:50]]
    began = time.time()
    assert classes(spark, texts) == set(range(20_000, 20_050))
    assert time.time() - began < 240
