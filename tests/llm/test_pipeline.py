"""The pipeline against the brute-force versions of its stages, one after the other."""

import random

import sentencepiece

import corpus_pipeline
from quire.llm import language

from .test_operators import contaminated, line_result, linked_classes, prose


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    english = "the of and to in is that it was for with on as his they at be this from have".split()
    german = "der die das und ist nicht ein zu von mit auf für sich dem den eine werden auch".split()

    def text(words, n):
        return "\n".join(" ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(12)) for _ in range(n))

    items = [(0, text(english, 2)), (1, prose(rng, 30))]
    texts = [text((english, german)[k % 2], rng.randrange(2, 9)) for k in range(24)]
    texts += [None, "", "123 456", "!!!", texts[0], texts[1] + "\n" + text(german, 1), texts[2].replace("the", "teh"), items[0][1], text(english, 3) + "\n" + items[1][1], "short\nshort", "Ein kurzer Text\n" * 3]
    # near copies that differ in every line by more than the line stage forgives
    texts += ["\n".join(line.replace(" ", " xxxx ", 1) for line in texts[5].split("\n"))]
    lang = [None if t is None else ("en", "de")[k % 2] if k < 24 else None for k, t in enumerate(texts)]
    spark.createDataFrame([(k, t, x, "s", 0) for k, (t, x) in enumerate(zip(texts, lang, strict=True))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = {k: t for k, t in enumerate(texts) if t and language.LETTERS.search(t)}
    ids = sorted(docs)
    gone = line_result([docs[k] for k in ids])
    kept = {}
    for place, k in enumerate(ids):
        parts = docs[k].split("\n")
        left = [x for n, x in enumerate(parts) if (place, n) not in gone]
        if "".join(left).strip() or len(left) == len(parts):
            kept[k] = "\n".join(left)
    ids = sorted(kept)
    classes = linked_classes([kept[k] for k in ids])
    kept = {k: kept[k] for place, k in enumerate(ids) if classes[place][1] == place}
    ids = sorted(kept)
    bad = contaminated([kept[k] for k in ids], items)
    p = sentencepiece.SentencePieceProcessor(model_file=language.DEFAULT_VOCABULARY)
    assert got == {k: p.encode(kept[k]) for place, k in enumerate(ids) if not bad[place][4]}
    assert 10 < len(got) < 30
