"""Line deduplication by an edit-distance join over segments.

A line of n characters is cut into MAX_EDITS + 1 segments. A line within MAX_EDITS of it holds one of the segments whole,
near its place; which substrings to look up follows from the two lengths (the multi-match-aware windows of the
partition-based join). Index entries and lookups meet by a hash of segment number, indexed length and characters.

Candidates must also be near in their bags of characters, and are then verified over the lines themselves with a banded
bit-parallel edit distance. Lists of many lines are first joined to one leader only. Where the components of those
links leave a list in more than one piece, the list is split: two lines within MAX_EDITS that share a segment are within
MAX_EDITS in what is left of them without it, so the rest is cut into segments again, and only lines that share one more
meet. That goes on until no long list is in pieces; pairs inside a component would change nothing.

Two edits would join unlike lines under MIN_CHARS characters, so those are joined by equality only, if SHORT says so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tokens as T
from ._components import components
from ._shared import written
from .jaccard import _bitmap, in_bitmap

MAX_EDITS = 2
MIN_CHARS = 20
#: What becomes of equal lines under MIN_CHARS characters that are not blank: all stay, those whose first stands in another
#: document go, or all but the first go.
SHORT = ("stay", "elsewhere", "go")
BLANK = (9, 10, 11, 12, 13, 32)
LONG_LIST = 64
#: A list of so many lines or fewer is paired rather than cut again: comparing their bags costs less.
WIDE_LIST = 4096
PER_BUCKET = 400_000
_SECOND = 0xC2B2AE3D27D4EB4F | 1


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of a and b if it is at most ``most``, else most + 1.

    Equal ends are cut off; what stays is computed by columns in bit vectors of 2 * most + 1 diagonals (Hyyro's banded
    form of Myers' method).
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    low, top = 0, min(len(a), len(b))
    step = 1 << max(0, top.bit_length() - 1)
    while step:  # the common prefix by doubling steps, as slices compare fast
        while low + step <= top and a[low : low + step] == b[low : low + step]:
            low += step
        step >>= 1
    a, b = a[low:], b[low:]
    high, top = 0, min(len(a), len(b))
    step = 1 << max(0, top.bit_length() - 1)
    while step:
        while high + step <= top and a[len(a) - high - step : len(a) - high] == b[len(b) - high - step : len(b) - high]:
            high += step
        step >>= 1
    a, b = a[: len(a) - high], b[: len(b) - high]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m > n + most:
        return most + 1
    if not n:
        return m
    # the top bit stands for row j + 1 + most while column j + 1 is made; rows run along a, columns along b
    width = max(64, 2 * most + 2)
    top = width - 1
    mask = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    vp, vn = (mask << (top - most)) & mask, 0
    score = most  # the value on the lowest diagonal, row most of column 0
    for j in range(n):
        eq = where.get(b[j], 0)
        shift = j + most - top
        eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        # the lowest diagonal goes down one row with each column
        score += 0 if d0 >> top & 1 else 1
        x = d0 >> 1
        vp = (hn | ~(x | hp)) & mask
        vn = x & hp
    # from row n + most of the last column up to row m
    row, value, bit = n + most, score, top - 1
    while row > m:
        value -= (vp >> bit & 1) - (vn >> bit & 1)
        row, bit = row - 1, bit - 1
    return min(value, most + 1)


class _Lines:
    """The lines of a chunk of texts: characters, bounds, hashes of any substring."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts)
        self.chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(self.chars == 10)
        self.start = np.concatenate(([0], ends + 1)).astype(np.int64)
        self.end = np.concatenate((ends, [len(self.chars)])).astype(np.int64)
        per = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
        self.row = np.repeat(np.arange(len(texts)), per)
        first = np.cumsum(per) - per
        self.no = np.arange(len(self.row)) - first[self.row]
        self.length = self.end - self.start
        n = len(self.chars)
        up, self.down = T.powers(n)
        with np.errstate(over="ignore"):
            c = T.mix(self.chars.astype(np.uint64))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * up[:n])))
            # a second hash of other summands, for the identity of whole lines
            self.more = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(c ^ np.uint64(_SECOND)) * up[:n])))

    def hash(self, s: np.ndarray, e: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums if sums is None else sums
        with np.errstate(over="ignore"):
            return T.mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def short(self) -> np.ndarray:
        """Whether lines are under MIN_CHARS characters and hold more than blanks."""
        few = np.flatnonzero(self.length < MIN_CHARS)
        n = self.length[few]
        chars = self.chars[ragged(self.start[few], n)]
        full = np.bincount(np.repeat(np.arange(len(few)), n), weights=~np.isin(chars, BLANK), minlength=len(few)) > 0
        out = np.zeros(len(self.length), bool)
        out[few[full]] = True
        return out

    def bags(self, which: np.ndarray) -> np.ndarray:
        """Counts of characters by their three lowest bits, modulo 256, as the bytes of a 64-bit number."""
        long_ = self.length[which]
        at = np.repeat(np.arange(len(which)), long_)
        chars = self.chars[ragged(self.start[which], long_)]
        return np.bincount(at * 8 + (chars & 7), minlength=8 * len(which)).astype(np.uint8).view(np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


def _cut(n: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of n characters; the last segments take what is left over."""
    k = MAX_EDITS + 1
    short, extra = n // k, n % k
    whole = k - extra  # so many segments are of the shorter length
    start = i * short + np.maximum(0, i - whole)
    return start, short + (i >= whole)


def _entries(x: _Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position in which, 1 for index entries) of the segments of lines and of the substrings they look up."""
    return _placed_entries(x, which, MIN_CHARS)[:3]


def _placed_entries(x: _Lines, which: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_entries with the start of each segment and its size; lines of fewer than ``least`` characters are not looked up."""
    out: list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]] = []
    start, n = x.start[which], x.length[which]
    rows = np.arange(len(which))

    def key(s: np.ndarray, size: np.ndarray, i: int, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return T.mix(x.hash(s, s + size) + np.uint64(i + 1) * np.uint64(0x8CB92BA72F3D8DD7) + length.astype(np.uint64) * np.uint64(0xAAAAAAAAAAAAAAAB))

    for shorter in range(MAX_EDITS + 1):
        other = n - shorter
        for i in range(MAX_EDITS + 1):
            p, size = _cut(other, i)
            if not shorter:
                out.append((key(start + p, size, i, other), rows, 1, start + p, size))
            low, high = max(-i, shorter - (MAX_EDITS - i)), min(i, shorter + MAX_EDITS - i)
            for d in range(low, high + 1):
                if not shorter and not d:
                    continue  # the line's own segment: index entries meet each other
                ok = (p + d >= 0) & (p + d + size <= n) & (other >= least)
                out.append((key((start + p + d)[ok], size[ok], i, other[ok]), rows[ok], 0, (start + p + d)[ok], size[ok]))
    flags = [np.full(len(k), f, np.uint8) for k, _, f, _, _ in out]
    keys, positions, _, begin, size = zip(*out, strict=True)
    return (*map(np.concatenate, (keys, positions, flags, begin, size)),)


def _narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h, rest, indexed) of rows (key, h, rest): the entries of what is left of a line, under its list's key (null for
    whole lines), and what is then left of it."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            x = _Lines(part.column("rest").to_pylist())
            which = np.flatnonzero(x.length > MAX_EDITS)
            if not len(which):
                continue
            keys, rows, flags, begin, size = _placed_entries(x, which, MAX_EDITS + 1)
            at = which[rows]
            if part.column("key").null_count < len(part):
                with np.errstate(over="ignore"):
                    keys = T.mix(keys ^ T.mix(part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[at]))
            rest = [(x.chars[a:b].tobytes() + x.chars[b + n : c].tobytes()).decode("utf-32-le", "surrogatepass") for a, b, n, c in zip(x.start[at].tolist(), begin.tolist(), size.tolist(), x.end[at].tolist(), strict=True)]
            yield pa.record_batch([pa.array(keys.view(np.int64)), part.column("h").take(pa.array(at)), pa.array(rest, pa.string()), pa.array(flags == 1)], ["key", "h", "rest", "indexed"])


def _ids(h: np.ndarray, g: np.ndarray) -> pa.Array:
    data = np.stack((h, g), axis=1).byteswap().tobytes()  # the highest byte first
    return pa.Array.from_buffers(pa.binary(16), len(h), [None, pa.py_buffer(data)]).cast(pa.binary())


def _scan(buckets: int, short: bool):
    """Rows of two kinds: a line of a text (short ones only if asked for), or the packed entries of one bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kind = batch = None
        for batch in batches:
            for i, j in T.text_chunks(batch.column("text"), T.CHUNK_BYTES // 2):
                part = batch.slice(i, j - i)
                x = _Lines(part.column("text").to_pylist())
                which = np.flatnonzero((x.length >= MIN_CHARS) | x.short() if short else x.length >= MIN_CHARS)
                h, g = x.hash(x.start[which], x.end[which]), x.hash(x.start[which], x.end[which], x.more)
                m = len(which)
                long_ = x.length[which] >= MIN_CHARS
                kind = part.column("id").type
                yield pa.record_batch([
                    part.column("id").take(pa.array(x.row[which])), part.column("th").take(pa.array(x.row[which])), pa.array(x.no[which], pa.int32()), _ids(h, g), pa.array(~long_),
                    pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["id", "th", "no", "line", "short", "bucket", "data"])
                which, h = which[long_], h[long_]
                _, first = np.unique(h, return_index=True)
                fresh = np.array([k for k in first.tolist() if int(h[k]) not in seen], np.int64)
                seen.update(h[fresh].tolist())
                if len(seen) > 400_000:
                    seen.clear()
                if not len(fresh):
                    continue
                bags = x.bags(which[fresh])
                keys, rows, flags = _entries(x, which[fresh])
                at = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(buckets + 1))
                some, data = np.flatnonzero(np.diff(cuts)), []
                for b in some:
                    o = order[cuts[b] : cuts[b + 1]]
                    r = rows[o]
                    data.append(np.array([len(o)], np.int64).tobytes() + keys[o].tobytes() + h[fresh][r].tobytes() + bags[r].tobytes() + flags[o].tobytes())
                k = len(some)
                yield pa.record_batch([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.bool_()), pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["id", "th", "no", "line", "short", "bucket", "data"])

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two bags allow MAX_EDITS: an edit changes at most two of the counts by one."""
    total = np.zeros(len(a), np.int64)
    for k in range(8):
        d = ((a >> np.uint64(8 * k)) - (b >> np.uint64(8 * k))).astype(np.uint8).astype(np.int64)
        total += np.minimum(d, 256 - d)
    return total <= 2 * MAX_EDITS


def _meet(_: tuple, table: pa.Table) -> pa.Table:
    """Candidate pairs (key null) of one bucket, and the members of its long lists (b null)."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for x in table.column("data"):
        raw = x.as_buffer()
        m = int(np.frombuffer(raw, np.int64, 1)[0])
        for k, (kind, at) in enumerate(((np.uint64, 8), (np.uint64, 8 + 8 * m), (np.uint64, 8 + 16 * m), (np.uint8, 8 + 24 * m))):
            parts[k].append(np.frombuffer(raw, kind, m, at))
    key, line, bag, flag = (np.concatenate(p) for p in parts)
    order = np.lexsort((line, 1 - flag, key))
    key, line, bag, flag = key[order], line[order], bag[order], flag[order]
    # a line that came from several tasks is one entry
    once = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (flag[1:] != flag[:-1])))
    key, line, bag, flag = key[once], line[once], bag[once], flag[once]
    begin, end = np.searchsorted(key, key, side="left"), np.searchsorted(key, key, side="right")
    use = (end - begin > 1) & (flag[begin] == 1)  # index entries come first
    long_ = use & (end - begin > LONG_LIST)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = (line[i] != line[j]) & _near(bag[i], bag[j])
        a, b = line[i[ok]], line[j[ok]]
        pairs.append((np.minimum(a, b), np.maximum(a, b)))

    at = np.flatnonzero(long_)
    add(begin[at], at)
    i, d = np.flatnonzero(use & ~long_ & (flag == 1)), 1
    while len(i):
        i = i[i + d < end[i]]
        add(i, i + d)
        d += 1
    both = np.unique(np.stack([np.concatenate([p[k] for p in pairs]) for k in (0, 1)], axis=1), axis=0) if pairs else np.zeros((0, 2), np.uint64)
    n, m = len(both), len(at)
    none = pa.nulls(n, pa.int64())
    return pa.table({
        "a": pa.array(np.concatenate((both[:, 0], line[at])).view(np.int64)),
        "b": pa.chunked_array([pa.array(both[:, 1].copy().view(np.int64)), pa.nulls(m, pa.int64())]).combine_chunks(),
        "key": pa.chunked_array([none, pa.array(key[at].view(np.int64))]).combine_chunks(),
        "bag": pa.chunked_array([none, pa.array(bag[at].view(np.int64))]).combine_chunks(),
        "indexed": pa.chunked_array([pa.nulls(n, pa.bool_()), pa.array(flag[at] == 1)]).combine_chunks(),
    })


def _wanted(bitmap: np.ndarray, holders: np.ndarray):
    """(h, line, text) of the lines whose hash may be among those wanted, from the texts that may hold one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(holders, batch.column("th").to_numpy())))
            for i, j in T.text_chunks(batch.column("text"), T.CHUNK_BYTES // 2):
                x = _Lines(batch.column("text").slice(i, j - i).to_pylist())
                which = np.flatnonzero(x.length >= MIN_CHARS)
                h = x.hash(x.start[which], x.end[which])
                hit = in_bitmap(bitmap, h)
                which, h = which[hit], h[hit]
                _, first = np.unique(h, return_index=True)
                first = np.array([k for k in first.tolist() if int(h[k]) not in seen], np.int64)
                seen.update(h[first].tolist())
                if len(seen) > 400_000:
                    seen.clear()
                which, h = which[first], h[first]
                text = [x.chars[s:e].tobytes().decode("utf-32-le") for s, e in zip(x.start[which], x.end[which], strict=True)]
                yield pa.record_batch([pa.array(h.view(np.int64)), _ids(h, x.hash(x.start[which], x.end[which], x.more)), pa.array(text, pa.string())], ["h", "line", "text"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [edit_distance(x, y, MAX_EDITS) <= MAX_EDITS for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
        yield batch.filter(pa.array(good, pa.bool_())).select(["h", "g", "a", "b"])


def _texts_of(texts: DataFrame, lines: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """(h, line, text) of the lines whose hash is a key of ends, a written table.

    texts (th, text) are read again for these lines only: of each one text that holds it is named by lines.
    """
    hashed = lines.filter("not short").select(F.conv(F.hex(F.substring("line", 1, 8)), 16, -10).cast("long").alias("key"), "th")
    holders = hashed.join(ends, "key", "left_semi").groupBy("key").agg(F.min("th").alias("th")).select(F.col("th").alias("key")).distinct()
    found = texts.mapInArrow(_wanted(_bitmap(ends), _bitmap(written(holders, f"{name}-holders"))), "h long, line binary, text string")
    return written(found.join(ends.withColumnRenamed("key", "h"), "h", "left_semi").dropDuplicates(["line"]), f"{name}-lines")


def _verified(pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The pairs of line hashes (a, b) whose lines, of ``found``, are within MAX_EDITS: hashes h and g, lines a and b."""
    one = found.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("text").alias("ta"))
    two = found.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("text").alias("tb"))
    full = pairs.join(one, "a").join(two, "b").select(F.col("a").alias("h"), F.col("b").alias("g"), F.col("la").alias("a"), F.col("lb").alias("b"), "ta", "tb")
    return written(full.mapInArrow(_verify, "h long, g long, a binary, b binary"), name)


def _links(texts: DataFrame, lines: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs of line hashes (a, b) whose lines are within MAX_EDITS, as _verified gives them."""
    pairs = written(pairs, f"{name}-pairs")
    # written, so that it is known to be small, or the join of a common line can be split
    ends = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), f"{name}-ends")
    return _verified(pairs, _texts_of(texts, lines, ends, name), name)


#: Rounds of splitting; a round takes a third off what is left of a line, so they end long before.
MOST_ROUNDS = 40


def _bag_distance(a: Column, b: Column) -> Column:
    total = F.lit(0).cast("long")
    for k in range(8):
        d = F.shiftrightunsigned(a, 8 * k).bitwiseAND(F.lit(255).cast("long")) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(F.lit(255).cast("long"))
        d = F.pmod(d, F.lit(256).cast("long"))
        total = total + F.least(d, 256 - d)
    return total


def _pieces(lists: DataFrame) -> DataFrame:
    """lists (key, h, indexed, comp, ...) that hold index entries and more than one component, with ``main``, their largest
    component, and ``wide``: whether they have over WIDE_LIST lines and, between components, over LONG_LIST pairs for each."""
    per = lists.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("any"))
    sizes = per.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max_by("comp", "n").alias("main"), F.max("any").alias("any"))
    cross = F.col("n") * F.col("n") - F.col("same")
    return lists.join(sizes.filter((cross > 0) & F.col("any")).select("key", "main", ((F.col("n") > WIDE_LIST) & (cross > LONG_LIST * F.col("n"))).alias("wide")), "key")


def _direct(lists: DataFrame) -> DataFrame:
    """The pairs (a, b) between components of lists that are not wide: lines outside the largest component with all lines,
    which is no more than twice the pairs between components."""
    few = lists.filter("not wide")
    more = ["bag"] if "bag" in lists.columns else []
    side = lambda df, p: df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("h", "comp", "indexed", *more)])
    both = side(few.filter("comp <> main"), "x").join(side(few, "y"), "key").filter("x_comp <> y_comp and (x_indexed or y_indexed)")
    if more:
        both = both.filter(_bag_distance(F.col("x_bag"), F.col("y_bag")) <= 2 * MAX_EDITS)
    return both.select(F.least("x_h", "y_h").alias("a"), F.greatest("x_h", "y_h").alias("b"))


def _split_lists(texts: DataFrame, lines: DataFrame, many: DataFrame, links: DataFrame) -> DataFrame:
    """links and those between the lines of long lists, many (key, h, bag, indexed), that links leave in pieces.

    Lists that are not wide give their pairs between components. In others each line is
    paired with a leader, and they go on to the next round with what is left of their lines: two lines that share a
    segment are as near in the rest as they are. Rests of MAX_EDITS characters or fewer can be cut no more; if even
    their lists are in pieces, all their pairs between pieces are verified.
    """
    comps = written(components(links, "h", "g"), "near-comps").select(F.col("node").alias("h"), "component")
    placed = written(many.join(comps, "h", "left").withColumn("comp", F.coalesce("component", "h")).drop("component"), "long-lists")
    lists = written(_pieces(placed), "long-pieces")
    links = links.union(_links(texts, lines, _direct(lists).distinct(), "near-rest"))
    lists = lists.filter("wide")
    if not lists.limit(1).count():
        return links
    ends = written(lists.select(F.col("h").alias("key")).distinct(), "long-ends")
    found = _texts_of(texts, lines, ends, "long")
    # the entries of whole lines are made again, for what is left of each line without the segment
    again = found.select(F.lit(None).cast("long").alias("key"), "h", F.col("text").alias("rest")).mapInArrow(_narrower, "key long, h long, rest string, indexed boolean")
    lists = written(again.join(lists.select("key", "h", "indexed", "comp").distinct(), ["key", "h", "indexed"]), "long-rests")
    for _ in range(MOST_ROUNDS):
        ready = _pieces(lists.filter(F.char_length("rest") <= MAX_EDITS)).withColumn("wide", F.lit(False))
        inner = lists.filter(F.char_length("rest") > MAX_EDITS).select("key", "h", "rest").mapInArrow(_narrower, "key long, h long, rest string, indexed boolean").distinct()
        inner = written(_pieces(inner.join(lists.select("h", "comp").distinct(), "h")), "narrower")
        wide = inner.filter("wide")
        leader = wide.groupBy("key").agg(F.min(F.when(F.col("indexed"), F.struct("h", "comp"))).alias("l"))
        led = wide.join(leader, "key").filter(F.col("comp") != F.col("l.comp")).select(F.least("h", "l.h").alias("a"), F.greatest("h", "l.h").alias("b"))
        near = _verified(written(_direct(inner).union(_direct(ready)).union(led).distinct(), "narrower-pairs"), found, "narrower-near")
        links = links.union(near)
        if not wide.limit(1).count():
            return links
        # components of components: only lines of these lists matter
        comp = written(lists.select("h", "comp").distinct(), "narrower-comps")
        of = lambda h, c: comp.select(F.col("h").alias(h), F.col("comp").alias(c))
        joined = components(near.select("h", "g").join(of("h", "x"), "h").join(of("g", "y"), "g").select("x", "y"), "x", "y")
        moved = wide.join(joined.select(F.col("node").alias("comp"), "component"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).select("key", "h", "rest", "indexed", "comp")
        lists = written(_pieces(moved).drop("main", "wide"), "long-rests")
        if not lists.limit(1).count():
            return links
    raise RuntimeError("long lists did not come apart")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: str = "stay") -> DataFrame:
    """(id, th, no): lines to drop, by document (its id and the hash of its text) and number from 0.

    Lines of at least MIN_CHARS characters within MAX_EDITS edits of each other, directly or through others, are one
    class; its first line by (id, number, hash of the text) stays. A null id comes before all others. Shorter lines that
    are not blank are a class if they are equal; ``short`` is one of SHORT.
    """
    if short not in SHORT:
        raise ValueError(f"short is one of {SHORT}")
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    # buckets follow the size of the texts, so that a bucket's task stays the same at any size
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(size / 300 * 12 / PER_BUCKET) + 1)
    scan = written(slim.mapInArrow(_scan(buckets, short != "stay"), f"id {kind}, th long, no int, line binary, short boolean, bucket int, data binary"), "lines")
    lines = scan.filter(F.col("bucket").isNull()).select("id", "th", "no", "line", "short")
    met = written(scan.filter(F.col("bucket").isNotNull()).select("bucket", "data").groupBy("bucket").applyInArrow(_meet, "a long, b long, key long, bag long, indexed boolean"), "met")
    pairs = met.filter(F.col("key").isNull()).select("a", "b").distinct()
    links = _links(slim.select("th", "text"), lines, pairs, "near")
    many = met.filter(F.col("key").isNotNull())
    if many.limit(1).count():
        links = _split_lists(slim.select("th", "text"), lines, many.select("key", F.col("a").alias("h"), "bag", "indexed"), links)
    comps = components(links.select("a", "b")).withColumnRenamed("node", "line")
    spot = F.struct("id", "no", "th")
    first = lines.groupBy("line").agg(F.min(spot).alias("spot"), F.count(F.lit(1)).alias("n"))
    classed = first.join(comps, "line", "left").withColumn("class", F.coalesce("component", "line"))
    heads = classed.groupBy("class").agg(F.min("spot").alias("stays"), F.sum("n").alias("m")).filter("m > 1")
    heads = classed.join(heads, "class").select("line", "stays")
    gone = ~spot.eqNullSafe(F.col("stays"))
    if short == "elsewhere":
        gone = gone & ~(F.col("short") & F.col("id").eqNullSafe(F.col("stays.id")) & F.col("th").eqNullSafe(F.col("stays.th")))
    return lines.join(heads, "line").filter(gone).select("id", "th", "no")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, lines, gone = [], [], []
        for text, drop in zip(batch.column("t"), batch.column("drop"), strict=True):
            text, drop = text.as_py(), set(drop.as_py() or ())
            parts = (text or "").split("\n") if text is not None else []
            lines.append(len(parts))
            gone.append(len(drop))
            out.append(text if not drop else "\n".join(p for k, p in enumerate(parts) if k not in drop))
        keep = [n for n in batch.schema.names if n not in ("t", "drop")]
        yield pa.record_batch([batch.column(n) for n in keep] + [pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array([zlib.crc32((t or "").encode()) for t in out], pa.int64())], [*keep, "t", "n_lines", "n_dropped", "text_crc32"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: str = "stay") -> DataFrame:
    """docs with the lines of dropped_lines() taken out of the text, and n_lines (before), n_dropped and text_crc32.

    A null text stays null and has no lines; an empty one has one empty line, which stays. Rows equal in id and text
    are one document, each keeps its row and the same lines. An empty table gives no rows. Other columns stay as they
    are, even with names like those added, which then get a leading underscore.
    """
    drop = dropped_lines(docs, id_col, text_col, short=short).groupBy("id", "th").agg(F.collect_set("no").alias("drop"))
    own = [c for c in docs.columns if c != text_col]
    slim = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)], F.col(text_col).cast("string").alias("t"), F.xxhash64(text_col).alias("th"))
    me = slim[f"c{own.index(id_col)}"]
    full = slim.join(drop, me.eqNullSafe(drop["id"]) & (slim["th"] == drop["th"]), "left").select(*[f"c{k}" for k in range(len(own))], "t", "drop")
    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(own))
    out = full.mapInArrow(_rewrite, f"{kinds}, t string, n_lines long, n_dropped long, text_crc32 long")
    added = ("n_lines", "n_dropped", "text_crc32")
    return out.select(*[F.col(f"c{own.index(c)}" if c != text_col else "t").alias(c) for c in docs.columns], *[F.col(a).alias(f"_{a}" if a in docs.columns else a) for a in added])
