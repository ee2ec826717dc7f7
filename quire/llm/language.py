"""Language identification by unigram piece models, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary. For each language a probability of each piece is learned by
expectation maximisation; a word's probability is the sum over all its segmentations into pieces, by the forward
algorithm, and a text's is the product over its words (runs of letters, in lower case, with the mark of a word's start).

Only the learning uses a sample: at most ``per_language`` texts of each language, those with the smallest hash of the
id. Every whole text is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as T
from ._trie import WIDEST, Table, Trie, hash_of

MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
SCALE = 1e4
FLOOR = 1e-6
CACHE = 400_000
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, in its order."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]


def split_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


class Lattice:
    """Segmentations of many words at once; row len(pieces) of a table of probabilities is for unknown characters.

    Words share the sums of their common prefixes in a trie. There probabilities are multiplied by SCALE for every
    character, so that no sum leaves the range of doubles; longer words are summed in logarithms.
    """

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        self.table = Table(np.array([hash_of(p) for p in pieces], np.uint64), np.arange(len(pieces)))
        self.lengths = np.array([*map(len, pieces), 1])

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, Trie]]:
        """Places of words, and the trie of these words; all but long ones."""
        marked = [MARK + w for w in words]
        order = sorted((k for k, w in enumerate(marked) if len(w) <= WIDEST), key=marked.__getitem__)
        for low in range(0, len(order), 30_000):
            some = order[low : low + 30_000]
            yield np.array(some), Trie([marked[k] for k in some], self.table, self.longest)

    def _arcs(self, trie: Trie, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for k, at, prior, i in trie.arcs(d):
            if k == 1:  # a character that is no piece is unknown
                full = np.full(len(trie.heads[d]), self.unknown)
                full[at] = i
                at = np.arange(len(full))
                prior, i = trie.before(d, at), full
            yield k, at, prior, i

    def _forward(self, trie: Trie, scaled: np.ndarray) -> list[np.ndarray]:
        f = [np.ones((1, scaled.shape[1]))]
        for d in range(1, trie.wide + 1):
            now = np.zeros((len(trie.heads[d]), scaled.shape[1]))
            for k, at, prior, i in self._arcs(trie, d):
                now[at] += f[d - k][prior] * scaled[i]
            f.append(now)
        return f

    def _ends(self, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
        """Depth and node of each word's end."""
        return trie.n, np.stack(trie.node)[trie.n, np.arange(len(trie.n))]

    def _scaled(self, table: np.ndarray) -> np.ndarray:
        return table * SCALE ** self.lengths[:, None].astype(float)

    def _long(self, words: list[str]) -> list[int]:
        return [k for k, w in enumerate(words) if len(w) + 1 > WIDEST]

    def _long_arcs(self, word: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each end in the marked word the places where pieces begin, and the pieces."""
        w, get, out = MARK + word, self.index.get, [(np.zeros(0, int), np.zeros(0, int))]
        for e in range(1, len(w) + 1):
            found = [(s, i) for s in range(max(0, e - self.longest), e - 1) if (i := get(w[s:e])) is not None]
            found.append((e - 1, get(w[e - 1], self.unknown)))
            out.append(tuple(np.array(x) for x in zip(*found, strict=True)))
        return out

    def _long_forward(self, arcs: list[tuple[np.ndarray, np.ndarray]], log: np.ndarray) -> np.ndarray:
        f = np.zeros((len(arcs), log.shape[1]))
        for e, (s, i) in enumerate(arcs[1:], 1):
            f[e] = np.logaddexp.reduce(f[s] + log[i], axis=0)
        return f

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        out, scaled = np.zeros((len(words), table.shape[1])), self._scaled(table)
        for some, trie in self._groups(words):
            f = self._forward(trie, scaled)
            d, x = self._ends(trie)
            base = np.cumsum([0, *map(len, f[:-1])])
            out[some] = np.log(np.concatenate(f)[base[d] + x]) - d[:, None] * np.log(SCALE)
        log = np.log(table)
        for k in self._long(words):
            out[k] = self._long_forward(self._long_arcs(words[k]), log)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts: of each word in each language."""
        out, scaled = np.zeros_like(table), self._scaled(table)
        for some, trie in self._groups(words):
            f = self._forward(trie, scaled)
            # what the words behind a node ask of it, from the deepest nodes up
            ask = [np.zeros_like(x) for x in f]
            for d in range(trie.wide, 0, -1):
                w = np.flatnonzero(trie.n == d)
                x = trie.node[d][w]
                ask[d][x] += counts[some[w]] / f[d][x]  # words are distinct, so are their ends
                for k, at, prior, i in self._arcs(trie, d):
                    back = scaled[i] * ask[d][at]
                    np.add.at(out, i, f[d - k][prior] * back)
                    np.add.at(ask[d - k], prior, back)
        log = np.log(table)
        for k in self._long(words):
            arcs = self._long_arcs(words[k])
            f = self._long_forward(arcs, log)
            b = np.full_like(f, -np.inf)
            b[-1] = 0
            for e in range(len(arcs) - 1, 0, -1):
                s, i = arcs[e]
                b[s] = np.logaddexp(b[s], b[e] + log[i])
                np.add.at(out, i, counts[k] * np.exp(f[s] + log[i] + b[e] - f[-1]))
        return out


def _learner(pieces: list[str], langs: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, out = Lattice(pieces), np.zeros_like(table)
        place = {x: i for i, x in enumerate(langs)}
        found: dict[str, np.ndarray] = {}

        def learn() -> None:
            nonlocal out
            if found:
                out = out + lattice.expected(list(found), np.array(list(found.values())), table)
                found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w, c in Counter(split_words(text or "")).items():
                    row = found.get(w)
                    if row is None:
                        row = found[w] = np.zeros(len(langs))
                    row[place[lang]] += c
                if len(found) > 100_000:
                    learn()
        learn()
        piece, lang = np.nonzero(out)
        yield pa.record_batch([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(out[piece, lang])], ["piece", "lang", "uses"])

    return run


def learn(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each piece and language) from labelled texts; null languages and ids are left out.

    What reaches the driver is a count for each language, then for each piece and language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    most = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1 << 30, (per_language << 30) // sizes[k])))])
    some = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30).cast("long")) < most[F.col(lang_col)])
    some = some.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    table = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    table[-1] = FLOOR
    for _ in range(rounds):
        uses = np.zeros_like(table)
        for r in some.mapInArrow(_learner(pieces, langs, table), "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"], r["lang"]] = r["uses"]
        uses[-1] = 0
        # a piece that a language has not shown gets a share by its use in all languages
        prior = uses.sum(axis=1, keepdims=True) + 0.01
        smooth = uses + 2.0 * prior / prior.sum() * len(langs)
        table = smooth / smooth.sum(axis=0, keepdims=True)
        table[-1] = FLOOR
        table = np.maximum(table, FLOOR * 1e-2)
    return langs, table


def _scorer(pieces: list[str], langs: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        index: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            for i, j in T.text_chunks(batch.column("text")):
                part = batch.slice(i, j - i)
                docs = [split_words(t) if t else [] for t in part.column("text").to_pylist()]
                if len(index) > CACHE:
                    index, scores = {}, scores[:0]
                fresh = list({w for ws in docs for w in ws if w not in index})
                if fresh and langs:
                    scores = np.concatenate((scores, lattice.log_probabilities(fresh, table)))
                    index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                pred, score = [], []
                for ws in docs:
                    if not ws or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = scores[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                yield pa.record_batch([part.column(c) for c in part.schema.names if c != "text"] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], [c for c in part.schema.names if c != "text"] + ["lang_pred", "score"])

    return run


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary_path: str = DEFAULT_VOCABULARY, keep: list[str] | None = None, **learning) -> DataFrame:
    """Per row of docs: the columns ``keep`` (id_col), lang_pred and score, the probability of lang_pred among all.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned. Ties go
    to the first language by name. Repeated rows each keep a row; an empty table gives none.
    """
    pieces = vocabulary(vocabulary_path)
    langs, table = learn(train, pieces, id_col, text_col, lang_col, **learning)
    keep = keep or [id_col]
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = slim.mapInArrow(_scorer(pieces, langs, table), f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
