"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text with every space as the mark and a mark in front splits into units that no piece crosses. The distinct units of
a chunk are sorted, which is the depth-first order of their trie; its nodes are worked out depth by depth, all nodes of
one depth at a time, so what a common prefix has is computed once.

Two states of a prefix are kept. ``best`` is the Viterbi step, the largest sum of scores over the pieces that end there:
the encoding of unigram models. The public vocabulary at hand is a BPE model, whose own encoding is not that of the
largest sum of any scores; its state is the last piece of the prefix's encoding, the one piece that ends the prefix and
is compatible with the state before it: side by side the two encode to themselves, which follows from the ranks of the
merges that made them. This gives the library's own ids.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as T
from ._trie import WIDEST, Table, Trie, hash_of
from .language import DEFAULT_VOCABULARY

MARK = "▁"
CACHE = 300_000


class Model:
    """Pieces, scores and kind of a SentencePiece model (dummy prefix, no other normalisation, spaces escaped)."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bpe = _field(p.serialized_model_proto(), 2, 3) == 2
        n = p.get_piece_size()
        self.text = [p.id_to_piece(i) for i in range(n)]
        self.byte = {int(x[3:5], 16): i for i, x in enumerate(self.text) if p.is_byte(i)}
        plain = [i for i in range(n) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {i: p.get_score(i) for i in plain}
        self.unknown = p.unk_id()
        self.unknown_score = min(self.score.values()) - 10.0
        # a model of merges has ranks, not scores; by Zipf's law a piece's share falls with its rank
        self.viterbi = {i: -math.log(2 + r) for r, i in enumerate(sorted(plain, key=lambda i: (-self.score[i], i)))} if self.bpe else self.score
        if self.bpe:
            self.unknown_score = min(self.viterbi.values()) - 10.0
        lone = not any("\n" in x and x != "\n" for x in self.id)
        self.units = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        # what a piece decodes to; of byte pieces the byte
        self.raw = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else x.replace(MARK, " ").encode() for i, x in enumerate(self.text)]

    def character(self, c: str) -> list[int]:
        """Ids of a character that is in no piece."""
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]


def _field(message: bytes, outer: int, inner: int) -> int | None:
    """The whole number in field ``inner`` of the message in field ``outer``; protocol buffers' wire format."""
    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0

        def number() -> int:
            nonlocal i
            out = shift = 0
            while True:
                out |= (data[i] & 127) << shift
                i += 1
                if data[i - 1] < 128:
                    return out
                shift += 7

        while i < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            elif key & 7 == 2:
                n = number()
                yield key >> 3, data[i : i + n]
                i += n
            else:
                i += 8 if key & 7 == 1 else 4

    for k, v in fields(message):
        if k == outer and isinstance(v, bytes):
            for k2, v2 in fields(v):
                if k2 == inner and isinstance(v2, int):
                    return v2
    return 1 if outer == 2 else None


class Encoder:
    """Encodes sorted words over their trie, depth by depth: what a common prefix has is computed once."""

    def __init__(self, model: Model):
        self.m = model
        texts, ids = list(model.id), np.array(list(model.id.values()), np.int64)
        self.size = max(map(len, texts), default=1)
        self.pieces = Table(np.array([hash_of(x) for x in texts], np.uint64), ids)
        self.gain = np.full(max(ids) + 1, model.unknown_score)
        self.gain[ids] = [model.viterbi[i] for i in ids]
        if model.bpe:
            self._merges(texts, ids)

    def _merges(self, texts: list[str], ids: np.ndarray) -> None:
        """Merge ranks (characters first), what adjacent pieces merge to, and the halves a piece was last merged from."""
        order = sorted(texts, key=lambda x: (len(x) > 1, -self.m.score[self.m.id[x]], self.m.id[x]))
        rank = {x: r for r, x in enumerate(order)}
        self.rank = np.full(max(ids) + 1, -1, np.int64)
        self.rank[[self.m.id[x] for x in order]] = np.arange(len(order))
        pairs = {rank[x[:k]] << 32 | rank[x[k:]]: r for r, x in enumerate(order) for k in range(1, len(x)) if x[:k] in rank and x[k:] in rank}
        self.joined = Table(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int64))
        self.left, self.right, self.reached = np.arange(len(order)), np.arange(len(order)), np.ones(len(order), bool)
        for r, x in enumerate(order):
            if len(x) > 1:
                halves = self.merged(x, whole=False)
                self.reached[r] = len(halves) == 2
                if self.reached[r]:
                    self.left[r], self.right[r] = rank[halves[0]], rank[halves[1]]
        self.plain = all(c in rank for x in texts for c in x)
        self.known, self.fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def merged(self, word: str, whole: bool = True) -> list[str]:
        """BPE by its definition: the best-scored pair that makes a piece is merged, the leftmost of equals.

        With whole false the merge that would make the word one piece is left out. Pairs wait in a heap, so that a run
        of n equal characters takes n log n steps.
        """
        get, score = self.m.id.get, self.m.score
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def push(k: int) -> None:
            if 0 <= k and after[k] < len(parts):
                x = parts[k] + parts[after[k]]
                i = get(x)
                if i is not None and (whole or len(x) < len(word)):
                    heapq.heappush(heap, (-score[i], k, x))

        for k in range(len(parts)):
            push(k)
        while heap:
            _, k, x = heapq.heappop(heap)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != x:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = x, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            push(before[k])
            push(k)
        return [x for x in parts if x is not None]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b (ranks) encode to themselves side by side: no merge across them comes before theirs."""
        key = a << 32 | b
        slot = (T.mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            new = new[first]
            x, y, limit = a[new].copy(), b[new].copy(), np.full(len(new), 1 << 40)
            ok, live = np.ones(len(new), bool), np.arange(len(new))
            while len(live):
                # undo the later of the two merges; what then meets must not have merged before that
                met = self.joined.find((x[live] << 32 | y[live]).view(np.uint64))
                bad = (met >= 0) & (met < limit[live])
                ok[live[bad]] = False
                live = live[~bad]
                u, v = x[live], y[live]
                lu, rv = self.right[u], self.left[v]
                one = (u > v) & (lu != u) | (rv == v) & (lu != u)
                two = ~one & (rv != v)
                limit[live] = np.where(one, u, v + 1)
                x[live] = np.where(one, lu, u)
                y[live] = np.where(two, rv, v)
                live = live[one | two]
            self.known[slot[new]], self.fits[slot[new]] = key[new], ok
            out = self.fits[slot]
            lost = self.known[slot] != key
            if lost.any():  # two new keys of one slot
                at = np.searchsorted(key[new], key[lost])
                there = (at < len(new)) & (key[new][np.minimum(at, len(new) - 1)] == key[lost])
                part = np.empty(int(lost.sum()), bool)
                part[there] = ok[at[there]]
                if not there.all():
                    part[~there] = self._fit(a[lost][~there], b[lost][~there])
                out[lost] = part
            return out
        return self.fits[slot]

    def encode_sorted(self, words: list[str], kinds: tuple[bool, ...] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind the ids of all words, which come sorted, and how many each has: those of the merges if the kind
        is true, else those of the best sum of scores."""
        kinds = kinds or (self.m.bpe,)
        plain = not any(kinds) or self.plain
        odd = [k for k, w in enumerate(words) if len(w) > WIDEST or MARK + MARK in w or not plain]
        rest = np.delete(np.arange(len(words)), odd)
        parts = [self._trie([words[k] for k in rest[low : low + 50_000]], kinds) for low in range(0, len(rest), 50_000)]
        out = []
        for c, bpe in enumerate(kinds):
            n = np.zeros(len(words), np.int64)
            n[rest] = np.concatenate([p[c][1] for p in parts]) if parts else 0
            alone = [self.ids(self.merged(words[k]) if bpe else self._best(words[k])) for k in odd]
            n[odd] = [len(x) for x in alone]
            first = np.cumsum(n) - n
            flat = np.zeros(int(n.sum()), np.int32)
            if parts:
                flat[ragged(first[rest], n[rest])] = np.concatenate([p[c][0] for p in parts])
            for k, x in zip(odd, alone, strict=True):
                flat[first[k] : first[k] + len(x)] = x
            out.append((flat, n))
        return out

    def _best(self, word: str) -> list[str]:
        """The best sum, character by character, for a word too long for the trie."""
        best, last = [0.0], [""]
        for e in range(1, len(word) + 1):
            found, value = word[e - 1], None
            for s in range(max(0, e - self.size), e):
                i = self.m.id.get(word[s:e])
                if i is None and e - s > 1:
                    continue
                v = best[s] + (self.m.unknown_score if i is None else self.m.viterbi[i])
                if value is None or v > value:
                    found, value = word[s:e], v
            best.append(value)
            last.append(found)
        out, e = [], len(word)
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def _trie(self, words: list[str], kinds: tuple[bool, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        trie = Trie(words, self.pieces, self.size)
        best, piece, back = ([[np.full(1, v)] for _ in kinds] for v in (0.0, -1, 0))
        for d in range(1, trie.wide + 1):
            m = len(trie.heads[d])
            top, found, size = ([np.full(m, v) for _ in kinds] for v in (-np.inf, -1, 1))
            for k, ends, prior, i in trie.arcs(d):
                for c, bpe in enumerate(kinds):
                    at, x = ends, i
                    if bpe:
                        open_ = found[c][at] < 0
                        at, x, before = at[open_], x[open_], piece[c][d - k][prior[open_]]
                        r = self.rank[x]
                        ok = self.reached[r]
                        if d > k:
                            two = np.flatnonzero(ok & (before >= 0))  # a character of no piece merges with nothing
                            ok[two] = self._fit(self.rank[before[two]], r[two])
                        at, x, value = at[ok], x[ok], 0.0
                    else:
                        value = best[c][d - k][prior] + self.gain[x]
                        ok = value > top[c][at]
                        at, x, value = at[ok], x[ok], value[ok]
                    top[c][at], found[c][at], size[c][at] = value, x, k
            for c in range(len(kinds)):
                none = np.flatnonzero(found[c] < 0)
                top[c][none] = best[c][d - 1][trie.before(d, none)] + self.m.unknown_score
                best[c].append(top[c])
                piece[c].append(found[c])
                back[c].append(size[c])
        return [self._trail(words, trie.n, trie.node, piece[c], back[c]) for c in range(len(kinds))]

    def _trail(self, words: list[str], n: np.ndarray, node: list[np.ndarray], piece: list[np.ndarray], back: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, read back from their ends, and how many each has."""
        base = np.cumsum([0, *map(len, piece[:-1])])
        piece_, back_ = np.concatenate(piece), np.concatenate(back)
        node_ = np.stack(node)
        steps, at, live = [], n.copy(), np.arange(len(words))
        while len(live):
            d = at[live]
            x = base[d] + node_[d, live]
            step = np.full(len(words), -1, np.int64)
            step[live] = np.where(piece_[x] >= 0, piece_[x], -1 - d)  # a character of no piece by its place, from 2 on
            steps.append(step)
            at[live] = d - back_[x]
            live = live[at[live] > 0]
        rows = np.stack(steps[::-1], axis=1)
        used = rows != -1
        per, flat = used.sum(axis=1), rows[used]
        none = np.flatnonzero(flat < -1)
        if len(none):
            word = np.repeat(np.arange(len(words)), per)
            more = {int(k): self.m.character(words[word[k]][-2 - flat[k]]) for k in none}
            count = np.ones(len(flat), np.int64)
            count[none] = [len(x) for x in more.values()]
            first = np.cumsum(count) - count
            wide = np.repeat(flat, count)
            for k, x in more.items():
                wide[first[k] : first[k] + len(x)] = x
            flat, per = wide, np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)
        return flat.astype(np.int32), per

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.m.id.get(p)
            if i is None:
                out.extend(x for c in p for x in self.m.character(c))
            else:
                out.append(i)
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1 ... of all runs, one after the other."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a model file, made once in a worker."""
    return Encoder(Model(path))


class _Known:
    """Ids of the units met so far, one after the other, and where each unit's begin."""

    def __init__(self):
        self.flat, self.at, self.n, self.used, self.units = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.flat, self.at, self.n = (np.concatenate((old[:k], new)) for old, k, new in ((self.flat, self.used, ids), (self.at, self.units, self.used + np.cumsum(n) - n), (self.n, self.units, n)))
        self.used, self.units = self.used + len(ids), self.units + len(n)

    def texts(self, units: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, given the units of all and how many each has, and where each text's begin."""
        ends = np.concatenate(([0], np.cumsum(self.n[units])))[np.concatenate(([0], np.cumsum(per)))]
        return self.flat[ragged(self.at[units], self.n[units])], ends


def _encoder(path: str, best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        model = code.m
        kinds = (model.bpe, False) if best else (model.bpe,)
        size = np.array([len(x) for x in model.raw], np.int64)
        raw = np.frombuffer(b"".join(model.raw), np.uint8)
        first = np.cumsum(size) - size
        index: dict[str, int] = {}
        known = [_Known() for _ in kinds]
        for batch in batches:
            for i, j in T.text_chunks(batch.column("text")):
                part = batch.slice(i, j - i)
                texts = part.column("text").to_pylist()
                docs = [model.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
                if len(index) > CACHE:
                    index, known = {}, [_Known() for _ in kinds]
                fresh = sorted(set(itertools.chain.from_iterable(docs)).difference(index))
                index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                per = np.fromiter(map(len, docs), np.int64, len(docs))
                units = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(docs)), np.int64, int(per.sum()))
                names = [c for c in part.schema.names if c != "text"]
                columns, added, same = [part.column(c) for c in names], [], np.ones(len(texts), bool)
                for have, got in zip(known, code.encode_sorted(fresh, kinds), strict=True):
                    have.add(*got)
                    out, ends = have.texts(units, per)
                    # decoded again: the bytes of all pieces, less the first space of each text
                    back = raw[ragged(first[out], size[out])].tobytes()
                    at = np.concatenate(([0], np.cumsum(size[out])))[ends]
                    same &= [not t or back[at[r] + 1 : at[r + 1]] == t.encode() for r, t in enumerate(texts)]
                    crc = [zlib.crc32(out[ends[r] : ends[r + 1]].astype("<i4").tobytes()) for r in range(len(texts))]
                    added += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns + added + [pa.array(same, pa.bool_())], [*names, *[f"x{k}" for k in range(len(added))], "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, best: bool = False) -> DataFrame:
    """Per row of docs: id, ids (the pieces), n_pieces, ids_crc32 (of the ids as little-endian 32-bit) and round_trip.

    ids are the library's own. With ``best`` there are best_ids, n_best and best_crc32 too: the segmentation of the
    largest sum of scores, which for a unigram model are the same ids; for a model of merges the scores are those of
    Zipf's law over its ranks. round_trip says that decoding gives the text back from either; it is false for a text
    that holds the mark U+2581 itself, which decodes to a space. Null and empty texts have no pieces. Repeated rows each
    keep a row; an empty table gives none; other columns are ignored, whatever their names. A character in no piece
    becomes its UTF-8 byte pieces.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["ids", "n_pieces", "ids_crc32", *(["best_ids", "n_best", "best_crc32"] if best else [])]
    kinds = ", ".join(f"x{k} {('array<int>', 'long', 'long')[k % 3]}" for k in range(len(names)))
    out = slim.mapInArrow(_encoder(vocabulary_path, best), f"id {docs.schema[id_col].dataType.simpleString()}, {kinds}, round_trip boolean")
    return out.select(F.col("id").alias(id_col), *[F.col(f"x{k}").alias(n) for k, n in enumerate(names)], "round_trip")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            texts = [None if ids is None else b"".join(map(model.raw.__getitem__, ids))[1:].decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) from lists of pieces; null stays null, an empty list is an empty text."""
    slim = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(_decoder(vocabulary_path), f"id {encoded.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
