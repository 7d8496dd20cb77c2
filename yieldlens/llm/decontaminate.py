"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts are word sequences (lower case, outer punctuation off; in scripts that set no spaces
between words every character is a word). A CGK random walk
reads a sequence and writes the word under its head at every step, moving on or not
by a random bit of (step, word); two sequences a few edits apart fall into step again,
so edit distance becomes Hamming distance of the written strings. Each of ``WALKS``
walks is sampled at ``SAMPLES`` of its steps, and the sampled words make one LSH key.

Document windows start at every ``stride``-th word and benchmark items are embedded
from every word on that leaves a walk enough to read, so an item anywhere in a document
meets several windows. Windows and items with equal keys are candidates. A candidate's
item-sized stretch must hold enough of the item's words for the allowed edits (a bound
that edit distance implies), and then the exact word edit distance between the item and
the best stretch there decides: at most ``(1 - similarity)`` times the item's words.

A walk often runs past the end of an item of fewer than ``SHORT`` words, so these are cut
into one piece more than they may have edits. An edit touches one piece, so one at least
stands unchanged in any stretch that matches: places that hold a piece are candidates,
and none is missed.

Items go to the tasks in blocks of at most ``BLOCK_WORDS`` words (one item may exceed
it); documents are never shuffled, and each is read whole.

Edge cases: null and empty texts match nothing; items of fewer than ``MIN_WORDS`` words
match where their words stand without any edit; repeated items and rows are reported or dropped each; rows with a
null doc_id are reported under null; empty tables give no matches; ``clean`` returns the
columns of its input, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored

SIMILARITY = 0.8
MIN_WORDS = 5
WALKS = 8                # repetitions
SAMPLES = 6              # sampled steps each
STEPS = 14               # steps of a walk
STRIDE = 4               # words between window starts, less if items are short
READS = 8                # words that an item's suffix must have for a walk
SHORT = 24               # words from which an item is found by walks
BLOCK_WORDS = 400_000
CHUNK = 400_000          # words whose windows are embedded at a time
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»„“”‘’–—…、。〈〉《》「」『』【】・！（），．：；？"
# Thai, Lao, Burmese, Khmer; kana and Han with their marks, also beyond the first plane
_UNSPACED = "[\u0e01-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1780-\u17d3\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff61-\uff9f\U00020000-\U0003ffff]"
_EACH = re.compile(_UNSPACED)
LISTED = 500_000         # candidates listed at a time
_CACHE = 300_000


class _Symbols(dict):
    """word as it stands -> 64-bit symbol of its normal form, 0 for marks alone."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        plain = word.lower().strip(_MARKS)
        symbol = self[word] = (xxhash.xxh64_intdigest(plain.encode(), 7) | 1) if plain else 0
        return symbol


@lru_cache(maxsize=1)
def _worker_symbols() -> _Symbols:
    """One per worker process, so it serves the tasks that follow."""
    return _Symbols()


def symbols(text: str | None, seen: _Symbols) -> np.ndarray:
    text = text or ""
    if not text.isascii() and _EACH.search(text):
        text = _EACH.sub(" \\g<0> ", text)
    words = text.split()
    out = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    return out[out != 0]


class Walks:
    """The random bits and sampled steps of all walks, fixed by a seed."""

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.odd = draw.integers(1, 1 << 63, (WALKS, STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = draw.integers(1, 1 << 63, (WALKS, STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sampled = [set(draw.choice(STEPS, SAMPLES, replace=False).tolist()) for _ in range(WALKS)]

    def keys(self, words: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """LSH keys of the sequences from ``starts`` on; ``words`` ends with STEPS zeros."""
        at = starts.copy()
        key = np.zeros(len(starts), np.uint64)
        last = max(self.sampled[walk])
        for step in range(last + 1):
            here = words[at]
            if step in self.sampled[walk]:
                key += (here ^ (here >> np.uint64(29))) * self.mix[walk, step]
            at += ((here * self.odd[walk, step]) >> np.uint64(63)).astype(np.int64)
        return key ^ (key >> np.uint64(31))


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Least word edits between ``item`` and any stretch of ``text``, and where the stretch
    ends; ``most + 1`` at least if there are more."""
    row = np.zeros(len(text) + 1, np.int64)                  # the stretch may start anywhere
    idx = np.arange(len(text) + 1)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - idx) + idx
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


_Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _table(keys: np.ndarray) -> _Table:
    """Keys in order, their places, and which low bits occur."""
    order = np.argsort(keys, kind="stable")
    present = np.zeros(1 << max(16, (32 * len(keys)).bit_length()), bool)
    present[(keys & np.uint64(len(present) - 1)).astype(np.int64)] = True
    return keys[order], order, present


def _hits(table: _Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``keys`` the table may have, the first place and number of each there, and the table's places."""
    ordered, order, present = table
    hit = np.flatnonzero(present[(keys & np.uint64(len(present) - 1)).astype(np.int64)])
    lo = np.searchsorted(ordered, keys[hit], side="left")
    return hit, lo, np.searchsorted(ordered, keys[hit], side="right") - lo, order


_FACTORS = np.random.default_rng(2).integers(1, 1 << 63, SHORT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _piece_keys(words: np.ndarray, size: int) -> np.ndarray:
    """The keys of all runs of ``size`` words."""
    mixed = words ^ (words >> np.uint64(29))
    key = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        key += mixed[k:k + len(key)] * _FACTORS[k]
    return key ^ (key >> np.uint64(31))


class Items:
    """One block of benchmark items with its LSH tables."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, min_words: int, stride: int):
        seen = _Symbols()
        self.ids, self.words = [], []
        for item_id, text in rows:
            w = symbols(text, seen)
            if len(w):
                self.ids.append(item_id)
                self.words.append(w)
        self.plain = [w.tolist() for w in self.words]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) if len(w) >= min_words else 0 for w in self.words]
        self.stride, self.walks, self.tables = stride, Walks(), []
        pad = np.zeros(STEPS + 1, np.uint64)
        flat = np.concatenate([x for w in self.words for x in (w, pad)] or [pad])
        starts, owner, offset, at = [], [], [], 0
        pieces: dict[int, list[tuple[int, int, int]]] = {}   # length -> place, item, offset of each piece
        for k, w in enumerate(self.words):
            if len(w) < SHORT:
                cuts = [len(w) * j // min(self.edits[k] + 1, len(w)) for j in range(min(self.edits[k] + 1, len(w)) + 1)]
                for o, end in zip(cuts, cuts[1:]):
                    pieces.setdefault(end - o, []).append((at + o, k, o))
            for o in range(len(w) - READS + 1 if len(w) >= SHORT else 0):
                starts.append(at + o)
                owner.append(k)
                offset.append(o)
            at += len(w) + len(pad)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        for walk in range(WALKS if starts else 0):
            self.tables.append(_table(self.walks.keys(flat, np.array(starts, np.int64), walk)))
        self.pieces = []
        for size, found in sorted(pieces.items()):
            places, owner, offset = np.array(found, np.int64).T
            self.pieces.append((size, _table(_piece_keys(flat, size)[places]), owner, offset))

    def candidates(self, words: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, word where the item would begin) for windows that share a key with it;
        ``docs`` names the document of each window."""
        yield from self._listed([(*_hits(table, self.walks.keys(words, starts, walk)), self.owner, self.offset)
                                 for walk, table in enumerate(self.tables)], starts, docs)

    def short_candidates(self, words: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same for places that hold a piece of a short item; ``docs`` names the document of each word."""
        yield from self._listed([(*_hits(table, _piece_keys(words, size)), owner, offset)
                                 for size, table, owner, offset in self.pieces], np.arange(len(words)), docs)

    @staticmethod
    def _listed(hits: list[tuple], starts: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The candidates of ``hits``. A passage that many items share meets all of them, so windows
        are listed in runs of about ``LISTED`` candidates."""
        if not hits:
            return
        load = np.zeros(len(starts), np.int64)
        for hit, _, n, *_ in hits:
            load[hit] += n
        cuts = (np.flatnonzero(np.diff(np.cumsum(load) // LISTED)) + 1).tolist()
        for first, last in zip([0, *cuts], [*cuts, len(starts)]):
            found = []
            for hit, lo, n, order, owner, offset in hits:
                a, b = np.searchsorted(hit, [first, last])
                many = n[a:b]
                rows = np.repeat(hit[a:b], many)
                places = order[np.repeat(lo[a:b], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                found.append(np.stack([docs[rows], owner[places], starts[rows] - offset[places]], axis=1))
            listed = np.unique(np.concatenate(found), axis=0)
            for k in range(0, len(listed), 10_000):
                yield from listed[k:k + 10_000].tolist()

    def matches(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edits, word of the stretch's end) of every verified pair."""
        pad = np.zeros(STEPS + 1, np.uint64)
        words = np.concatenate([x for w in docs for x in (w, pad)] or [pad])
        sizes = np.array([len(w) + len(pad) for w in docs], np.int64)
        firsts = np.cumsum(sizes) - sizes
        windows = [np.arange(f, f + len(w), self.stride) for f, w in zip(firsts, docs)]
        if not any(map(len, windows)):
            return
        of = np.repeat(np.arange(len(docs)), [len(w) for w in windows])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for doc, item, begin in chain(self.candidates(words, np.concatenate(windows), of),
                                      self.short_candidates(words, np.repeat(np.arange(len(docs)), sizes))):
            n, most = len(self.words[item]), self.edits[item]
            # the stretch looked at reaches twice as far as edits can shift it, so begins nearby need no second look
            if abs(begin - tried.get((doc, item), begin - most - 1)) <= most or best.get((doc, item), (1, 0))[0] == 0:
                continue
            tried[doc, item] = begin
            first = int(firsts[doc])
            lo, hi = max(begin - 2 * most, first), min(begin + n + 2 * most, first + len(docs[doc]))
            text = words[lo:hi]
            if sum(map(set(text.tolist()).__contains__, self.plain[item])) < n - most:
                continue
            edits, end = edit_distance(self.words[item], text, most)
            if edits <= most and edits < best.get((doc, item), (most + 1, 0))[0]:
                best[doc, item] = edits, lo + end - first
        for (doc, item), (edits, end) in sorted(best.items()):
            yield doc, item, edits, end


def _blocks(items: DataFrame, similarity: float, min_words: int) -> Iterator[Items]:
    """Item blocks of a proven size, each collected alone."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).distinct().withColumn(
        "words", F.size(F.split("text", "\\s+")) + F.length(F.regexp_replace("text", "[^" + _UNSPACED[1:], "")))
    total, shortest = rows.agg(F.sum("words"), F.min(F.when(F.col("words") >= min_words, F.col("words")))).first()
    if not total:
        return
    stride = STRIDE if shortest is None else max(1, min(STRIDE, (int(shortest) - READS) // 2))
    n = -(-total * 3 // (2 * BLOCK_WORDS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Items([(r["item_id"], r["text"]) for r in rows.where(part == k).collect()], similarity, min_words, stride)


def _batches(texts: list[str | None], seen: _Symbols) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first, word sequences) of runs of texts of about CHUNK words."""
    first, held, words = 0, 0, []
    for k, text in enumerate(texts):
        words.append(symbols(text, seen))
        held += len(words[-1])
        if held >= CHUNK:
            yield first, words
            first, held, words = k + 1, 0, []
    if words:
        yield first, words


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, edits, similarity, end_word: a row per document id and item that its text holds."""
    def searcher(block: Items):
        def run(batches):
            seen = _worker_symbols()
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for first, words in _batches(batch.column(1).to_pylist(), seen):
                    for d, item, edits, end in block.matches(words):
                        out.append((ids[first + d], block.ids[item], edits, 1 - edits / len(block.words[item]), end))
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64(),
                                                              pa.int64()))],
                    ["doc_id", "item_id", "edits", "similarity", "end_word"])
        return run

    schema = "doc_id long, item_id long, edits int, similarity double, end_word long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = [arrow_map(rows, searcher(b), schema) for b in _blocks(items, similarity, min_words)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct("edits", "similarity", "end_word")).alias("best")
    return (stored(reduce(DataFrame.unionByName, found), "leaks").groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "best.*"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    at = docs.columns.index("text")

    def keeper(block: Items):
        def run(batches):
            seen = _worker_symbols()
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for first, words in _batches(batch.column(at).to_pylist(), seen):
                    for d, *_ in block.matches(words):
                        stays[first + d] = False
                yield batch.filter(pa.array(stays))
        return run

    for block in _blocks(items, similarity, min_words):
        docs = arrow_map(docs, keeper(block), docs.schema)
    return docs
