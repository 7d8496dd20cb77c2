"""Hierarchical multi-length packing.

Documents are tokenized, ended by one end id and routed to context-size tiers
(the longest tier that they fill, else the shortest). Tier by tier, longest first,
each document fills whole windows of its tier; what is left over opens one more
window, whose gap is filled from the documents of shorter tiers, the longest that
fit first, the last one cut to fit. What remains below the shortest tier is run
together, so windows are full but for the last. The windows are dealt to step
groups of equal token totals with the same mix of lengths.

Packing goes on inside each input partition, in pools of at most ``POOL`` tokens
(one document may exceed it), so nothing is shuffled, memory is bounded, and a
lost task repeats only its own partition. The last tokens of a partition, fewer
than the shortest tier, are cut into powers of two, which need no padding.

Edge cases: a null text counts as empty (the end id alone); a null doc_id is
carried; repeated rows are packed as often as they come; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .tokens import word_tokenizer

TIERS = (2048, 1024, 512, 256)
POOL = 2_000_000         # tokens packed together
STEP = 16                # longest windows whose tokens make one step group
END_ID = 1


class Piece:
    """``length`` ids of document ``doc`` from ``start`` on."""
    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: int, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    return Piece(piece.doc, piece.start, n), Piece(piece.doc, piece.start + n, piece.length - n)


class _ByLength:
    """Pieces in order of length: the longest that fits, or the longest of all."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = sorted(pieces, key=lambda p: p.length)
        self.lengths = [p.length for p in self.pieces]

    def __len__(self) -> int:
        return len(self.pieces)

    def take(self, k: int) -> Piece:
        self.lengths.pop(k)
        return self.pieces.pop(k)

    def fitting(self, room: int) -> Piece | None:
        k = bisect_right(self.lengths, room)
        return self.take(k - 1) if k else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(window size, pieces) of full windows, and the pieces of the last, shorter run."""
    tiers = tuple(sorted(tiers, reverse=True))
    routed: list[list[Piece]] = [[] for _ in tiers]
    for doc, n in enumerate(lengths):
        if n:
            routed[next((k for k, t in enumerate(tiers) if n >= t), len(tiers) - 1)].append(Piece(doc, 0, n))
    full: list[tuple[int, list[Piece]]] = []
    shorter = [_ByLength(x) for x in routed]
    loose: list[Piece] = []
    for k, tier in enumerate(tiers):
        rests = []
        while len(shorter[k]):
            piece = shorter[k].take(len(shorter[k]) - 1)
            while piece.length >= tier:
                head, piece = _cut(piece, tier)
                full.append((tier, [head]))
            if piece.length:
                rests.append(piece)
        if k == len(tiers) - 1:
            loose.extend(rests)
            break
        for rest in rests:
            window, room = [rest], tier - rest.length
            for lower in shorter[k + 1:]:
                while room and (p := lower.fitting(room)):
                    window.append(p)
                    room -= p.length
            if room:                                        # none fits whole: cut one of the shortest tier left
                lower = next((x for x in reversed(shorter[k + 1:]) if len(x)), None)
                if lower:
                    head, tail = _cut(lower.take(0), room)
                    window.append(head)
                    room = 0
                    at = next((j for j, t in enumerate(tiers) if tail.length >= t), len(tiers) - 1)
                    shorter[at] = _insert(shorter[at], tail)
            if room:                                        # nothing shorter is left
                loose.extend(window)
            else:
                full.append((tier, window))
    return _run_together(full, loose, tiers)


def _insert(lengths: _ByLength, piece: Piece) -> _ByLength:
    k = bisect_right(lengths.lengths, piece.length)
    lengths.lengths.insert(k, piece.length)
    lengths.pieces.insert(k, piece)
    return lengths


def _run_together(full, loose, tiers):
    """Windows filled with the loose pieces in turn, the longest size that they still fill."""
    left = sum(p.length for p in loose)
    queue, k = list(loose), 0
    while (tier := next((t for t in tiers if t <= left), 0)):
        window, room = [], tier
        while room:
            piece = queue[k]
            if piece.length <= room:
                k += 1
            else:
                piece, queue[k] = _cut(piece, room)
            window.append(piece)
            room -= piece.length
        full.append((tier, window))
        left -= tier
    return full, queue[k:]


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group per window: longest first to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    heapify(groups)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        held, g = groups[0]
        heapreplace(groups, (held + sizes[k], g))
        out[k] = g
    return out


def _last_windows(rest: list[Piece]) -> list[tuple[int, list[Piece]]]:
    left = sum(p.length for p in rest)
    return _run_together([], rest, tuple(1 << b for b in range(left.bit_length(), -1, -1)))[0]


_COLUMNS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long",
            "sequence_id": "long", "offset": "long", "window": "int", "step_group": "long"}


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window (its sequence's size) and step_group; ``with_ids`` adds the ids themselves."""
    schema = ", ".join(f"`{c}` {t}" for c, t in _COLUMNS.items()) + (", ids array<int>" if with_ids else "")
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        tokenizer = word_tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        pool: list[tuple] = []                               # (doc_id, id bytes, tokens of the document, ids before)
        held = sequences = groups = 0

        def emit(windows):
            nonlocal sequences, groups
            step = step_groups([size for size, _ in windows], STEP * max(tiers))
            out = {c: [] for c in _COLUMNS}
            ids = []
            for (size, pieces), g in zip(windows, step):
                offset = 0
                for p in pieces:
                    doc_id, raw, total, before = pool[p.doc]
                    part = memoryview(raw)[4 * p.start:4 * (p.start + p.length)]
                    for c, v in zip(_COLUMNS, (doc_id, before + p.start, p.length, zlib.crc32(part), total,
                                               base + sequences, offset, size, base + groups + g)):
                        out[c].append(v)
                    if with_ids:
                        ids.append(part.cast("I").tolist())
                    offset += p.length
                sequences += 1
            groups += max(step, default=-1) + 1
            types = {"long": pa.int64(), "int": pa.int32()}
            arrays = [pa.array(out[c], types[t]) for c, t in _COLUMNS.items()]
            names = list(_COLUMNS)
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

        def flush(last: bool):
            nonlocal pool, held
            windows, rest = pack([len(x[1]) // 4 for x in pool], tiers)
            if last:
                yield from emit(windows + _last_windows(rest))
            else:
                yield from emit(windows)
                pool = [(pool[p.doc][0], pool[p.doc][1][4 * p.start:4 * (p.start + p.length)], pool[p.doc][2],
                         pool[p.doc][3] + p.start) for p in rest]
                held = sum(p.length for p in rest)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = tokenizer.encode(text.as_py() or "") + end
                pool.append((doc_id, raw, len(raw) // 4, 0))
                held += len(raw) // 4
                if held >= POOL:
                    yield from flush(last=False)
        if pool:
            yield from flush(last=True)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
