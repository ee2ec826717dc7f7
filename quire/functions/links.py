"""Links inside text: ``[label](target)``, written from label and target, and found again in any text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation: a backslash in front of any of it makes it plain.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = " \t"


def markup(label: Column, target: Column) -> Column:
    """``[label](target)``: all punctuation of the label escaped, backslashes and ampersands of the target; a target with
    white space stands in angle brackets, of which those inside are escaped, in another one round brackets are too."""
    shown = F.regexp_replace(label, r"(\p{Punct})", r"\\$1")
    plain = F.regexp_replace(target, r"([\\&])", r"\\$1")
    spaced = target.rlike(r"(?U)[\s\x1c-\x1f]")
    inner = F.when(spaced, F.concat(F.lit("<"), F.regexp_replace(plain, "([<>])", r"\\$1"), F.lit(">"))).otherwise(F.regexp_replace(plain, "([()<>])", r"\\$1"))
    return F.concat(F.lit("["), shown, F.lit("]("), inner, F.lit(")"))


class _Scan:
    """A text with a place in it; every method moves on and says where it got to, or None where its part is not there."""

    def __init__(self, text: str):
        self.text, self.end = text, len(text)

    def at(self, i: int) -> str:
        return self.text[i] if i < self.end else ""

    def until(self, i: int, closing: str, barred: str) -> int | None:
        """Behind the next ``closing`` that no backslash is in front of, without passing an unescaped one of ``barred``."""
        while i < self.end:
            c = self.text[i]
            if c == closing:
                return i + 1
            if c in barred:
                return None
            if c == "\\":
                i += 1
                if self.at(i) in ("", "\n"):
                    return None
            i += 1
        return None

    def blanks(self, i: int) -> int:
        while self.at(i) and self.at(i) in _BLANK:
            i += 1
        return i

    def bare(self, i: int) -> int:
        """The end of a target that is not in angle brackets: no white space, round brackets in pairs one deep."""
        while i < self.end:
            c = self.text[i]
            if c == "(":
                group = self.until(i + 1, ")", "(")
                if group is None:
                    return i
                i = group
            elif c == ")" or c.isspace():
                return i
            elif c == "\\":
                if self.at(i + 1) in ("", "\n"):
                    return i
                i += 2
            else:
                i += 1
        return i

    def closed(self, i: int) -> int | None:
        """Behind the bracket that ends a link, past a title in quotes or brackets if one stands behind blanks."""
        quote = self.blanks(i)
        ends = {'"': '"', "'": "'", "(": ")"}
        if quote > i and self.at(quote) in ends and self.at(quote):
            behind = self.until(quote + 1, ends[self.at(quote)], "(" if self.at(quote) == "(" else "")
            if behind is not None:
                last = self.blanks(behind)
                if self.at(last) == ")":
                    return last + 1
        return quote + 1 if self.at(quote) == ")" else None

    def link(self, i: int) -> tuple[str, str, int] | None:
        """(label, target, end) of the link whose square bracket stands at i; both as they are written."""
        if i and self.text[i - 1] == "!":
            return None
        behind = self.until(i + 1, "]", "[")
        if behind is None or behind == i + 2 or self.at(behind) != "(":
            return None
        first = behind + 1
        if self.at(first) == "<":
            inner = first + 1
            while self.at(inner) and self.at(inner) not in "<>\n":
                inner += 1
            if self.at(inner) == ">":
                end = self.closed(inner + 1)
                if end is not None:
                    return self.text[i + 1 : behind - 1], self.text[first + 1 : inner], end
        last = self.bare(first)
        end = self.closed(last)
        if end is None:
            return None
        target = self.text[first:last]
        return self.text[i + 1 : behind - 1], target[1:-1] if target[:1] == "<" and target[-1:] == ">" else target, end


def _plain(text: str) -> str:
    """text without the backslashes in front of punctuation."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] and text[i + 1] in PUNCTUATION:
            i += 1
        out.append(text[i])
        i += 1
    return "".join(out)


def found(text: str) -> Iterator[tuple[str, str | None]]:
    """(text, url) around and inside the links of a text, in order; url is None outside. A text without links is one."""
    scan, start, i, any_ = _Scan(text), 0, text.find("["), False
    while i >= 0:
        link = scan.link(i)
        if link:
            if i > start:
                yield text[start:i], None
            yield _plain(link[0]), _plain(link[1])
            start, any_ = link[2], True
        i = text.find("[", link[2] if link else i + 1)
    if start < len(text) or not any_:
        yield text[start:], None


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())])))
def _segments(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))
    return pa.array([None if t is None else [{"text": a, "url": b} for a, b in found(t)] for t in texts.to_pylist()], kind)


def segments(text: Column) -> Column:
    """The text around and inside links as an array of (text, url); url is null outside links, null for a null text.

    Texts without a square bracket are not sent to Python.
    """
    whole = F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("url")))
    return F.when(text.isNull(), F.lit(None)).when(F.instr(text, "[") == 0, whole).otherwise(_segments(text))
