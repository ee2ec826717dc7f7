"""Exact n-gram Jaccard self-join by grouped prefixes, and the classes that its links make.

A text's set is its distinct 5-word shingles, as 64-bit hashes. Two sets x, y with 100 * |x & y| >= 75 * |x | y| share a
token within their prefixes, the first |x| - ceil(0.75 |x|) + 1 tokens in any order that is the same for all.

1. Texts with equal sets fall into one class by a hash of the set; from here on a class is one node.
2. In an order that puts the tokens of a single text first, a text with as many of those as its prefix is long can
   have no link. Every token is counted once, and only the other texts go on, with their sets.
3. Classes with the same prefix and size are a group, and classes of a group that are connected are one unit. A token
   at place i (from 0) of a prefix of size n leaves n - i tokens, so it can be the first that a pair has in common only
   if both have as many left as the pair's overlap must be; this bounds the sizes of the partners at that token.
4. Leaders, round by round: of every token, and of every group, two classes of its largest component, drawn anew, are
   compared with the others that the bounds admit and that are not connected to them yet; a class verifies few such
   pairs a round. So a family of near copies becomes one component by links in proportion to its size.
5. The exact step covers all that is left. Entries of a token are collapsed by component into one group with the
   loosest bounds of its members; pairs of groups that the bounds admit are expanded to units, then to members, and
   verified. Pairs inside one component are left out: a link there would change no component.
6. Components of all verified links.

No pair is dropped by a cap: leaders only bring links forward, step 5 covers all pairs between different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tokens as T
from ._components import components
from ._shared import written

SKETCH_BITS = 20
TOKENS_PER_BUCKET = 1_500_000
BATCH_BYTES = 16 << 20
#: Rounds of leaders, and by how many each has more links tried for a class than the one before.
LEADER_ROUNDS, DRAWN = 3, 3
BITMAP_BITS = 23
NUM, DEN = 75, 100


def _keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's whole set: sums of two scramblings of its tokens, and its size."""
    with np.errstate(over="ignore"):
        one = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(values + np.uint64(0xA0761D6478BD642F)))))
        two = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(values ^ np.uint64(0xE7037ED1A0B428DB)))))
        a, b = one[offsets[1:]] - one[offsets[:-1]], two[offsets[1:]] - two[offsets[:-1]]
        return T.mix(T.mix(a) + T.mix(b + np.uint64(77)) + np.diff(offsets).astype(np.uint64))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, tokens, offsets) of parts of a batch whose columns are id and text."""
    for i, j in T.text_chunks(batch.column(1)):
        part = batch.slice(i, j - i)
        values, offsets = T.shingles(T.words(part.column(1)))
        yield part, values, offsets


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its size and key."""
    for batch in batches:
        for part, values, offsets in _sets(batch):
            yield pa.record_batch([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(_keys(values, offsets).view(np.int64))], ["id", "n", "key"])


def _deal_tokens(buckets: int):
    """Per batch of texts and bucket of tokens: 40 bits of each token and the number of its text; bucket 0 has the keys too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            yield from _dealt(*(np.concatenate([h[k] for h in held]) for k in range(3)), number, buckets)
            number, held, size = number + 1, [], 0

        for batch in batches:
            for part, values, offsets in _sets(batch):
                keys, n = _keys(values, offsets), np.diff(offsets)
                fresh = np.zeros(len(n), bool)
                for i, k in enumerate(keys.tolist()):
                    if n[i] and k not in seen:
                        seen.add(k)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                held.append((keys[fresh], n[fresh], values[np.repeat(fresh, n)]))
                size += 8 * len(values) + 64 * len(n)
                if size >= BATCH_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _dealt(keys: np.ndarray, n: np.ndarray, token: np.ndarray, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
    text = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    bucket = (token % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    token, text = (token >> np.uint64(24))[order], text[order]
    low = np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, :5])
    some = np.union1d(np.flatnonzero(np.diff(cuts)), [0])
    for k in range(0, len(some), 32):
        data, head = [], []
        for b in some[k : k + 32]:
            x = slice(cuts[b], cuts[b + 1])
            t = text[x]
            step = np.diff(t, prepend=t[:1]).astype(np.uint32)
            data.append(np.array([len(t), int(t[0]) if len(t) else 0], np.int64).tobytes() + low[x].tobytes() + pa.compress(step.tobytes(), "zstd", asbytes=True))
            head.append(keys.tobytes() + n.tobytes() if b == 0 else None)
        m = len(data)
        yield pa.record_batch([pa.array(some[k : k + 32], pa.int32()), pa.array([number] * m, pa.int64()), pa.array([len(n)] * m, pa.int64()), pa.array(data, pa.binary()), pa.array(head, pa.binary())], ["bucket", "batch", "texts", "data", "head"])


def _single(_: tuple, table: pa.Table) -> pa.Table:
    """For each batch, how many tokens of this bucket each of its texts has to itself."""
    tokens, texts = [], []
    for x in table.column("data"):
        raw = x.as_buffer()
        m, first = (int(v) for v in np.frombuffer(raw, np.int64, 2))
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * m, 16).reshape(-1, 5)
        tokens.append(wide.reshape(-1).view(np.uint64))
        step = np.frombuffer(pa.decompress(raw[16 + 5 * m :], 4 * m, "zstd", asbytes=True), np.uint32)
        texts.append(first + np.cumsum(step, dtype=np.int64))
    token = np.concatenate(tokens)
    order = np.argsort(token)
    begin = np.flatnonzero(np.diff(token[order], prepend=~token[order][:1]) != 0) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(token)))
    alone = np.empty(len(token), bool)
    alone[order] = np.repeat(size == 1, size)
    out, at = [], 0
    for text, n in zip(texts, table.column("texts").to_pylist(), strict=True):
        own = np.bincount(text, weights=alone[at : at + len(text)], minlength=n).astype(np.uint32)
        out.append(pa.compress(own.tobytes(), "zstd", asbytes=True))
        at += len(text)
    return pa.table({"batch": table.column("batch"), "texts": table.column("texts"), "own": pa.array(out, pa.binary()), "head": table.column("head")})


def _suspects(_: tuple, table: pa.Table) -> pa.Table:
    """The texts of a batch with fewer tokens of their own than their prefix is long."""
    n = table.column("texts")[0].as_py()
    own = np.zeros(n, np.int64)
    for x in table.column("own"):
        own += np.frombuffer(pa.decompress(x.as_py(), 4 * n, "zstd", asbytes=True), np.uint32)
    raw = next(h.as_py() for h in table.column("head") if h.is_valid)
    keys, sizes = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n)
    some = own < prefix_length(sizes)
    return pa.table({"key": keys[some]})


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of whole numbers as unsigned ones, and where each list begins in them."""
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of tokens by the upper bits of the hash, in 16 parts."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        values, offsets = _lists(batch.column("tokens"))
        np.add.at(counts, (values[offsets[0] : offsets[-1]] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    if counts.any():
        data = [pa.compress(p.astype(np.uint32).tobytes(), "zstd", asbytes=True) for p in counts.reshape(16, -1)]
        yield pa.record_batch([pa.array(range(16), pa.int32()), pa.array(data, pa.binary())], ["part", "counts"])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    size = (1 << SKETCH_BITS) // 16
    total = np.zeros(size, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(pa.decompress(x.as_py(), size * 4, "zstd", asbytes=True), np.uint32)
    data = pa.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), "zstd", asbytes=True)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([data], pa.binary())})


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUM * n + DEN - 1) // DEN + 1


def _prefixes(sketch: np.ndarray):
    """(key, n, gkey, prefix) of sets (key, tokens): the group's key and the prefix in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            values, offsets = _lists(batch.column("tokens"))
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                own = values[low:high]
                n = len(own)
                order = np.argsort(sketch[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix = own[order[: prefix_length(np.array([n]))[0]]]
                group = _keys(np.sort(prefix), np.array([0, len(prefix)]))[0] ^ T.mix(np.array([n], np.uint64))[0]
                for column, v in zip(rows, (n, int(group), prefix.view(np.int64)), strict=True):
                    column.append(v)
            yield pa.record_batch([
                batch.column("key"), pa.array(rows[0], pa.int64()), pa.array(np.array(rows[1], np.uint64).view(np.int64)), pa.array(rows[2], pa.list_(pa.int64()))],
                ["key", "n", "gkey", "prefix"])

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap with the places of all keys (a column ``key``) set; 1 MB, and up to 8 MB for many keys."""
    bits = min(26, max(BITMAP_BITS, int(keys.count()).bit_length() + 3))
    place = F.pmod(F.col("key"), F.lit(1 << bits).cast("long"))
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(1 << bits, bool)
    for r in rows:  # at most 2 ** 26 / 32768 rows of 4 KB
        # bucket numbers begin at 1 for places from 1; place 0 is in bucket 0
        on = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        at = (r["b"] - 1) * 32768 + 1 + np.flatnonzero(on) if r["b"] > 0 else -np.flatnonzero(on)
        out[np.asarray(at) % (1 << bits)] = True
    return np.packbits(out)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of 64-bit keys are set."""
    place = (keys.view(np.int64) % (8 * len(bitmap))).astype(np.int64)
    return ((bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)


def _members(bitmap: np.ndarray):
    """(key, tokens) of the texts whose key may be among those wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, offsets in _sets(batch):
                keys = _keys(values, offsets)
                out_k, out_v = [], []
                if len(seen) > 200_000:
                    seen.clear()
                for i in np.flatnonzero(in_bitmap(bitmap, keys)):
                    k = int(keys[i])
                    if offsets[i] == offsets[i + 1] or k in seen:
                        continue
                    seen.add(k)
                    out_k.append(k)
                    out_v.append(values[offsets[i] : offsets[i + 1]].view(np.int64))
                yield pa.record_batch([pa.array(np.array(out_k, np.uint64).view(np.int64)), pa.array(out_v, pa.list_(pa.int64()))], ["key", "tokens"])

    return run


def _verified(sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of class keys whose sets meet the threshold."""
    one, two = (sets.select(F.col("key").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    same, both = F.size(F.array_intersect("ta", "tb")), F.size("ta") + F.size("tb")
    return written(pairs.join(one, "a").join(two, "b").filter(DEN * same >= NUM * (both - same)).select("a", "b"), name)


DEALT = "bucket int, batch long, texts long, data binary, head binary"


def _rest(dealt: DataFrame) -> DataFrame:
    """(key): texts that have fewer tokens to themselves than their prefix is long."""
    single = dealt.groupBy("bucket").applyInArrow(_single, "batch long, texts long, own binary, head binary")
    return single.groupBy("batch").applyInArrow(_suspects, "key long")


def _hooked(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed (key, comp, size) after links (a, b) of keys: each component joins the largest one that it is linked to.

    Components that are linked need not all become one; the last step has all links once more.
    """
    rank = lambda k: F.struct(F.col(f"s{k}").alias("size"), F.col(f"c{k}").alias("comp"))
    ends = links.join(placed.toDF("a", "ca", "sa"), "a").join(placed.toDF("b", "cb", "sb"), "b").filter("ca <> cb")
    ends = ends.select(F.least(rank("a"), rank("b")).alias("low"), F.greatest(rank("a"), rank("b")).alias("high"))
    hook = written(ends.groupBy(F.col("low.comp").alias("comp")).agg(F.max("high")["comp"].alias("to")), "hooks")
    far = hook
    for _ in range(2):  # hooks lead from smaller to larger, so these are trees; most are no deeper than this
        far = far.join(hook.toDF("to", "on"), "to", "left").select("comp", F.coalesce("on", "to").alias("to"))
    now = placed.join(far, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp"))
    # written, so that a large component's join can be split
    sizes = written(now.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    return written(now.join(sizes, "comp", "left").select("key", "comp", F.coalesce("size", F.lit(1)).alias("size")), "placed")


def _units(pre: DataFrame, placed: DataFrame) -> DataFrame:
    """(unit, key): each class, and the class that stands for those of its group and component."""
    full = pre.select("key", "gkey").join(placed.select("key", "comp"), "key")
    return full.join(full.groupBy("gkey", "comp").agg(F.min("key").alias("unit")), ["gkey", "comp"]).select("unit", "key")


def _entries(pre: DataFrame) -> DataFrame:
    """(t, key, n, most) of the tokens of each class's prefix, and of its group; most: the largest partner's size there."""
    rows = pre.select("key", "n", F.posexplode("prefix").alias("i", "t"))
    most = F.floor((NUM + DEN) * (F.col("n") - F.col("i")) / NUM) - F.col("n")
    group = pre.select(F.col("gkey").alias("t"), "key", "n", F.floor(F.col("n") * DEN / NUM).alias("most"))
    return rows.select("t", "key", "n", most.alias("most")).union(group)


def _admitted(n: str, most: str, m: str, least: str) -> Column:
    """Whether sizes n and m are near enough, and each is within what the other's place admits."""
    return (F.col(m) <= F.col(most)) & (F.col(n) <= F.col(least)) & (DEN * F.least(n, m) >= NUM * F.greatest(n, m))


def _led(sets: DataFrame, pre: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """After the rounds of leaders: (key, comp, size) of all classes, the entries of tokens that several components
    have, and the links found."""
    placed = pre.select("key", F.col("key").alias("comp"), F.lit(1).cast("long").alias("size"))
    entries = written(_entries(pre).withColumn("comp", F.col("key")).withColumn("size", F.lit(1).cast("long")), "entries")
    found = []
    for k in range(LEADER_ROUNDS):
        # a token within one component has nothing to give; of the others two of the largest component lead: the one with
        # the fewest rarer tokens, which is most like the rest, and one drawn from those whose place admits its own size
        h = F.xxhash64("key", "t", F.lit(k)) if k else F.xxhash64("key")
        first = F.min(F.struct(-F.col("size"), F.col("n") - F.col("most"), h, "key", "n", "most", "comp"))
        last = F.max(F.struct("size", F.col("most") >= F.col("n"), h, "key", "n", "most", "comp"))
        lead = entries.groupBy("t").agg(first.alias("x"), last.alias("y"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        of = lambda c: F.struct(F.col(c)["key"].alias("a"), F.col(c)["n"].alias("na"), F.col(c)["most"].alias("ma"), F.col(c)["comp"].alias("ca"))
        lead = written(lead.select("t", F.inline(F.array(of("x"), of("y")))), "leaders")  # written, so that a common token's join can be split
        met = entries.join(lead, "t").filter((F.col("comp") != F.col("ca")) & _admitted("n", "most", "na", "ma"))
        # the leader of most of a class's tokens, and others at random, more in later rounds
        drawn = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("a", F.lit(k)).alias("h"), "a"))), 1, 1 + DRAWN * k)["a"]
        some = met.groupBy("key").agg(F.array_union(F.array(F.mode("a", True)), drawn).alias("a"))
        found.append(_verified(sets, some.select(F.explode("a").alias("a"), F.col("key").alias("b")), "led"))
        placed = _hooked(placed, found[-1])
        # components only grow, so a token within one stays so
        mixed = entries.select("t", "key", "n", "most").join(lead.select("t").distinct(), "t", "left_semi")
        entries = written(mixed.join(placed, "key").select("t", "key", "n", "most", "comp", "size"), "entries")
    return placed, entries, found


def _open(entries: DataFrame) -> DataFrame:
    """(t, cx, cy): pairs of groups, the entries of a token in a component, that the bounds admit."""
    groups = written(entries.groupBy("t", "comp").agg(F.min("n").alias("n"), F.max("most").alias("most")), "groups")
    several = groups.groupBy("t").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("t")
    groups = written(groups.join(several, "t", "left_semi"), "mixed-groups")
    one, two = (groups.toDF("t", f"c{k}", f"n{k}", f"m{k}") for k in "xy")
    # the loosest bounds of a group: its smallest member and the largest partner of any
    near = (F.col("cx") < F.col("cy")) & (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my"))
    return written(one.join(two, "t").filter(near).select("t", "cx", "cy"), "group-pairs")


def _unit_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): units of different components that the bounds admit at a token that both have in their prefixes."""
    one, two = (entries.select("t", "key", "n", "most", "comp").toDF("t", f"k{k}", f"n{k}", f"m{k}", f"c{k}") for k in "xy")
    both = _open(entries).join(one, ["t", "cx"]).join(two, ["t", "cy"]).filter(_admitted("nx", "mx", "ny", "my"))
    return both.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b")).distinct()


def _expanded(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs of units as pairs of their members."""
    return pairs.join(units.toDF("a", "ka"), "a").join(units.toDF("b", "kb"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles and component_id, the smallest id reachable by links (ids are whole numbers).

    Null, empty and blank texts have no shingles, are linked with nothing and are their own component. Equal rows share
    a component; rows of one id but different texts are told apart. A null id never names a component unless all ids of
    the component are null. An empty table gives no rows; other columns are ignored, whatever their names.
    """

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(slim.mapInArrow(_scan, "id long, n long, key long"), "scan")
    classes = rows.filter(F.col("n") > 0).groupBy("key", "n").agg(F.min("id").alias("rep"))

    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(total // TOKENS_PER_BUCKET) + 1)
    suspects = written(_rest(slim.mapInArrow(_deal_tokens(buckets), DEALT)).distinct(), "suspects")
    found = slim.mapInArrow(_members(_bitmap(suspects)), "key long, tokens array<long>")
    sets = written(found.join(suspects, "key", "left_semi").dropDuplicates(["key"]), "sets")

    parts = sets.mapInArrow(_count, "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    size = (1 << SKETCH_BITS) // 16
    for r in parts:  # 16 rows, 4 MB at most
        sketch[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(pa.decompress(bytes(r["counts"]), size * 4, "zstd", asbytes=True), np.uint32)
    # a difference within the noise of the sketch says nothing, so counts are compared by their magnitude
    level = np.floor(np.log2(sketch.astype(np.float64) + 1) * 2).astype(np.uint8)

    pre = written(sets.mapInArrow(_prefixes(level), "key long, n long, gkey long, prefix array<long>"), "prefixes")
    placed, entries, found = _led(sets, pre)
    units = written(_units(pre, placed), "units")
    heads = units.filter(F.col("unit") == F.col("key")).select("key")
    pairs = _expanded(_unit_pairs(entries.join(heads, "key", "left_semi")), units)
    links = _verified(sets, pairs, "met")
    for more in found:
        links = links.union(more)
    whole = components(links.union(placed.filter("key <> comp").select(F.col("comp").alias("a"), F.col("key").alias("b")))).toDF("key", "component")

    named = classes.join(whole, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("key", "n", "component_id")
    full = rows.filter(F.col("n") > 0).join(named, ["key", "n"]).select("id", "n", "component_id")
    none = rows.filter(F.col("n") == 0).select("id", "n", F.col("id").alias("component_id"))
    return full.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
