import struct

import pytest

from quire.sources import legacy


@pytest.mark.parametrize("text", ["hello\nworld", "é ü €\n日本語 \U0001f600 x\n" * 300, "", "a" * 5000, "x\n" * 9000])
def test_binary_round_trip(text):
    assert "\n".join(t for t, _ in legacy.paragraphs(legacy.build(text))) == text


def test_fields_cells_and_breaks():
    assert legacy.evaluate_fields("a\x13 LINK \x13 X \x14in\x15 \x14result\x15b\x15") == "aresultb"
    got = legacy.paragraphs(legacy.build("c1\x07c2\x07\x07after\x0cnew"))
    assert got == [("c1", True), ("c2", True), ("", True), ("after", False), ("\f", False), ("new", False)]


def test_broken_files(spark):
    good = legacy.build("text")
    cases = [b"", b"PK\x03\x04", good[:600], good[:512] + b"\xff" * 512 + good[1024:], None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "doc_id long, content binary")
    assert all(r["load_error"] for r in legacy.doc_paragraphs(df).collect())
    with pytest.raises((ValueError, struct.error)):
        legacy.paragraphs(legacy.compound({"WordDocument": b"\0" * 4096}))
