"""Edit-aware token counts with pre-token segment trees.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum over its
pre-tokens. Each document keeps a segment tree: its leaves are runs of ``LEAF`` pre-tokens
(code points and tokens of each run), its inner nodes the sums of both. An edit (replace the
code points [start, end) by a text) descends to the leaves it touches, re-encodes them with
the leaf before as context, goes on until a new pre-token starts where an old leaf started,
replaces those leaves and updates the sums above them. Untouched leaves are never read.

``build`` makes the trees, ``apply_edits`` the trees and counts after edits; a document's
edits are sent as one array with its row, in the order of application, so neither step
shuffles a text.

Edge cases: null and empty texts have a tree without leaves and no tokens; edits beyond the
end are moved to the end, null fields of an edit count as 0 or as an empty text, a null edit
or edit list does nothing; a null doc_id is carried; repeated rows are counted each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

LEAF = 64                # pre-tokens a leaf
CROWD = 16               # leaves of a place at the bottom of a tree, at most
REACH = 3                # code points after a pre-token's end that can decide it
CACHE = 400_000
# Fixed value: the pre-token pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Pre-tokens of a text and their token counts."""

    def __init__(self, ranks_path: str):
        import regex
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[token] = len(self.encoding._encode_single_piece(token.encode()))
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """(code points, tokens) of each leaf of a text."""
        parts = self.pattern.findall(text)
        counts, lengths = list(map(self.count, parts)), list(map(len, parts))
        at = range(0, len(parts), LEAF)
        return [sum(lengths[k:k + LEAF]) for k in at], [sum(counts[k:k + LEAF]) for k in at]


@lru_cache(maxsize=1)
def counter_of(ranks_path: str) -> Counter:
    """One per worker process, so its cache serves the tasks that follow."""
    return Counter(ranks_path)


class Tree:
    """Leaves under binary nodes that hold the sums of their code points and tokens. A place at the bottom holds a few
    leaves, one at first, so that an edit that makes more or fewer of them changes the sums above its places
    only; the tree is made anew when a place holds more than ``CROWD`` or most are empty."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self._grow(list(zip(chars, tokens)))

    def _grow(self, leaves: list[tuple[int, int]]) -> None:
        self.places = [[x] for x in leaves]
        self.used = len(leaves)                              # places that hold leaves
        self.room = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [(0, 0)] * self.room + leaves + [(0, 0)] * (self.room - len(leaves))
        for node in range(self.room - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        (a, b), (c, d) = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a + c, b + d)

    @property
    def chars(self) -> int:
        return int(self.sums[1][0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1][1])

    @property
    def end(self) -> tuple[int, int]:
        return len(self.places), 0

    def leaves(self) -> tuple[list[int], list[int]]:
        """(code points, tokens) of each leaf, in order."""
        every = [x for place in self.places for x in place]
        return [int(c) for c, _ in every], [int(t) for _, t in every]

    def size(self, at: tuple[int, int]) -> int:
        """Code points of a leaf; leaves are known by (place, number in it)."""
        return int(self.places[at[0]][at[1]][0])

    def find(self, char: int) -> tuple[tuple[int, int], int]:
        """(leaf that holds this code point, code point where it starts); (end, chars) at the end."""
        if char >= self.chars:
            return self.end, self.chars
        node, start = 1, 0
        while node < self.room:
            node *= 2
            if char >= start + self.sums[node][0]:
                start += int(self.sums[node][0])
                node += 1
        k = 0
        while char >= start + self.size((node - self.room, k)):
            start += self.size((node - self.room, k))
            k += 1
        return (node - self.room, k), start

    def after(self, at: tuple[int, int]) -> tuple[int, int]:
        place, k = at[0], at[1] + 1
        while place < len(self.places) and k >= len(self.places[place]):
            place, k = place + 1, 0
        return place, k

    def before(self, at: tuple[int, int]) -> tuple[int, int] | None:
        place, k = at[0], at[1] - 1
        while k < 0:
            place -= 1
            if place < 0:
                return None
            k = len(self.places[place]) - 1
        return place, k

    def replace(self, lo: tuple[int, int], hi: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """The leaves from ``lo`` to before ``hi`` become these, dealt over the places between."""
        new = list(zip(chars, tokens))
        if not self.places:
            self._grow(new)
            return
        last = len(self.places) - 1
        (a, i), (b, j) = ((last, len(self.places[last])) if x == self.end else x for x in (lo, hi))
        new = [*self.places[a][:i], *new, *self.places[b][j:]]
        each = -(-len(new) // (b - a + 1))
        for k in range(a, b + 1):
            self.used -= bool(self.places[k])
            self.places[k] = new[(k - a) * each:(k - a + 1) * each]
            self.used += bool(self.places[k])
        if each > CROWD or 2 * self.used < len(self.places):
            self._grow([x for place in self.places for x in place])
            return
        for k in range(a, b + 1):
            self.sums[self.room + k] = (sum(c for c, _ in self.places[k]), sum(t for _, t in self.places[k]))
        a, b = (self.room + a) // 2, (self.room + b) // 2
        while a:
            for node in range(a, b + 1):
                self._add_up(node)
            a, b = a // 2, b // 2


def edit(tree: Tree, text: str, start: int, end: int, put: str, counter: Counter) -> tuple[str, int]:
    """The text after the edit, and how many of its code points were encoded anew; the tree follows."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    lo, at = tree.find(max(0, start - REACH))
    context = tree.before(lo)                                # one leaf of context before
    if context:
        lo = context
        at -= tree.size(lo)
    shift = len(put) - (end - start)
    after = text[:start] + put + text[end:]
    hi, limit = tree.find(end)
    if hi < tree.end and limit < end:
        limit += tree.size(hi)
        hi = tree.after(hi)
    chars, tokens, size, made, n = [], [], 0, 0, 0
    here = at
    for m in counter.pattern.finditer(after, at):
        while hi < tree.end and limit + shift < m.start():   # that leaf starts inside a new pre-token
            limit += tree.size(hi)
            hi = tree.after(hi)
        if hi < tree.end and limit + shift == m.start() and limit >= end:
            break
        size += m.end() - m.start()
        made += counter.count(m[0])
        n += 1
        here = m.end()
        if n == LEAF:
            chars.append(size)
            tokens.append(made)
            size = made = n = 0
    else:
        hi = tree.end
    if n:
        chars.append(size)
        tokens.append(made)
    tree.replace(lo, hi, chars, tokens)
    return after, here - at


_TREE = "doc_id long, chars long, tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def build(docs: DataFrame, ranks_path: str) -> DataFrame:
    """The tree of every document: doc_id, chars, tokens, leaf_chars, leaf_tokens."""
    def run(batches: Iterator[pa.RecordBatch]):
        counter = counter_of(ranks_path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chars, tokens = counter.leaves(text or "")
                out.append((doc_id, sum(chars), sum(tokens), chars, tokens))
            yield _batch(out, [("doc_id", pa.int64()), ("chars", pa.int64()), ("tokens", pa.int64()),
                               ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _TREE)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def apply_edits(docs: DataFrame, edits: Column, ranks_path: str, trees: bool = False) -> DataFrame:
    """doc_id, tokens_before, tokens_after, chars_before, chars_after, n_edits and recounted_chars
    (code points encoded anew) after the edits in this column: an array of
    (from_char int, to_char int, put string), applied one after the other. ``trees`` adds
    leaf_chars and leaf_tokens after the edits. Rows of ``docs`` that carry leaf_chars and
    leaf_tokens start from that tree; others build theirs first."""
    kept = [F.col(c) if c in docs.columns else F.lit(None).cast("array<int>").alias(c)
            for c in ("leaf_chars", "leaf_tokens")]
    edits = edits.cast("array<struct<from_char:int,to_char:int,put:string>>").alias("edits")
    fields = [(c, pa.int64()) for c in ("doc_id", "tokens_before", "tokens_after", "chars_before", "chars_after",
                                        "n_edits", "recounted_chars")]
    if trees:
        fields += [("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))]

    def run(batches):
        counter = counter_of(ranks_path)
        for batch in batches:
            out = []
            for doc_id, text, changes, chars, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                tree = Tree(*(counter.leaves(text) if chars is None or tokens is None else (chars, tokens)))
                before, recounted, n = (tree.tokens, tree.chars), 0, 0
                for change in changes or ():
                    if change is not None:
                        text, more = edit(tree, text, change["from_char"] or 0, change["to_char"] or 0,
                                          change["put"] or "", counter)
                        recounted, n = recounted + more, n + 1
                row = (doc_id, before[0], tree.tokens, before[1], tree.chars, n, recounted)
                out.append((*row, *tree.leaves()) if trees else row)
            yield _batch(out, fields)

    schema = ", ".join(f"{c} long" for c, _ in fields[:7]) + (
        ", leaf_chars array<int>, leaf_tokens array<int>" if trees else "")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), edits, *kept), run, schema)


def sample_edits(text: Column) -> Column:
    """Edits that every text gets in the registered query: a source mark before the first character,
    the removal of the middle tenth, and a note in place of the last twentieth (on the text as it
    then is)."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    mark, note = "source: crawl\n", " [cut here]"
    size = F.lit(len(mark)) + n
    part = F.floor(n / 10).cast("int")
    left = size - part
    change = lambda a, b, put: F.struct(a.cast("int").alias("from_char"), b.cast("int").alias("to_char"),
                                        F.lit(put).alias("put"))
    middle = F.floor(size / 2).cast("int")
    return F.array(change(F.lit(0), F.lit(0), mark), change(middle, middle + part, ""),
                   change(left - F.floor(left / 20), left, note))
