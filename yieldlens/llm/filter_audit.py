"""Filter interaction audit with radix text tries.

Five filters fail a text: A too few words, B too many repeated words, C too many capitals,
D a forbidden character, E a text that a smaller doc_id holds as well. ``audit`` applies them in
all orders and counts, for every source, what each step keeps, removes and would have removed.

Method. One pass over the documents makes each row's mask of A to D and collects the
distinct texts of a window of ``WINDOW`` bytes, each under a key with its smallest doc_id, so
that a text held by a third of all rows is one row a window. The distinct texts are range-
partitioned by adaptive prefixes: a prefix with more than ``target`` bytes of text below it is
replaced by longer ones until it has less or covers its texts whole, so equal texts always meet
in one range and a common opening does not fill one. Each range inserts its whole texts into a
compressed trie whose terminals hold the minimum doc_id, and is then traversed for the
minimum of every key. Back on the rows, E fails where the doc_id is above its key's minimum.
The masks are reduced to counts per source, 32 masks and labels; all 600 steps follow from these.

Edge cases: a null text or source is empty; a null doc_id never fails E, takes no part in the
minima and has no labels; rows that share doc_id and text do not fail E by each other; of
several labels of a doc_id a 1 wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT = 65            # least per cent of distinct words
CAPITALS = 5             # most per cent of capitals
FORBIDDEN = b"#$%&*|"
WINDOW = 32 << 20        # bytes of distinct texts gathered before they are sent on
TARGET = 8 << 20         # bytes of text from which a prefix is made longer
FIRST, GROWTH = 16, 16   # bytes of the shortest prefix, and how much longer the next one is
_CAPITAL = bytes(range(65, 91))


def mask_of(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()                                     # bytes split at ASCII white space only
    capitals = len(text) - len(text.translate(None, _CAPITAL))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < DISTINCT * len(words)) << 1
            | (100 * capitals > CAPITALS * n_chars) << 2
            | (len(text.translate(None, FORBIDDEN)) < len(text)) << 3)


def masked_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row (key, doc_id, part, mask) per document, and one (key, low, text) per distinct text of a
    window; key names a text within its window, low is the smallest doc_id there."""
    fields = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()),
                        ("low", pa.int64()), ("text", pa.binary())])

    def run(batches):
        first = TaskContext.get().partitionId() << 36
        seen: dict[bytes, list] = {}                         # text: key, mask, smallest doc_id
        held = used = 0

        def texts():
            for text, (key, _, low) in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], f.type) for x, f in zip((key, None, None, None, low, text), fields)], schema=fields)

        for batch in batches:
            keys, masks = [], []
            sizes = pc.utf8_length(batch.column(2)).to_pylist()
            for doc_id, text, n in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), sizes):
                entry = seen.get(text)
                if entry is None:
                    entry = seen[text] = [first + used, mask_of(text, n), doc_id]
                    used, held = used + 1, held + len(text)
                elif doc_id is not None and (entry[2] is None or doc_id < entry[2]):
                    entry[2] = doc_id
                keys.append(entry[0])
                masks.append(entry[1])
            none = lambda t: pa.nulls(len(keys), t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0), batch.column(1), pa.array(masks, pa.int32()),
                 none(pa.int64()), none(pa.binary())], schema=fields)
            if held >= window:
                yield from texts()
                seen, held = {}, 0
        yield from texts()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return arrow_map(docs.select(F.col("doc_id").cast("long"), text("source").alias("part"), text("text").alias("text")),
                     run, "key long, doc_id long, part string, mask int, low long, text binary")


def with_prefixes(texts: DataFrame, target: int = TARGET) -> DataFrame:
    """``texts`` (with a binary column text) and prefix: the shortest of the tried lengths with at most
    ``target`` bytes of text below it, or the whole text."""
    done, left, size = [], texts, FIRST
    while True:
        here = left.withColumn("prefix", F.substring("text", 1, size))
        longer = F.length("text") > size                     # the others have no longer prefix
        full = stored(here.groupBy("prefix").agg(F.sum(F.length("text")).alias("n"), F.max(longer).alias("more"))
                      .where((F.col("n") > target) & F.col("more")).select("prefix"), "trie-full-prefixes")
        if full.isEmpty():
            done.append(here)
            break
        done += [here.where(~longer), here.where(longer).join(full, "prefix", "left_anti")]
        left = here.where(longer).join(full, "prefix", "left_semi").drop("prefix")
        size *= GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class _Node:
    """A trie node; the label of the edge to it is ``text[lo:hi]`` of some inserted text."""
    __slots__ = ("text", "lo", "hi", "kids", "low", "keys")

    def __init__(self, text: bytes, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        self.kids: dict[int, _Node] = {}
        self.low: int | None = None
        self.keys: list[int] = []


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common part of ``a[i:]`` and ``b[j:]``, at most ``most``."""
    lo = 0
    while lo < most:
        step = 1
        while lo + step <= most and a[i + lo:i + lo + step] == b[j + lo:j + lo + step]:
            lo, step = lo + step, step * 2
        if step == 1:
            break
    return lo


class Trie:
    """Compressed radix trie over bytes; terminals hold the smallest id and the keys of their text."""

    def __init__(self):
        self.root = _Node(b"", 0, 0)

    def insert(self, text: bytes, key: int, low: int | None) -> None:
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = _Node(text, at, len(text))
                node = kid
                break
            length = kid.hi - kid.lo
            same = _common(kid.text, kid.lo, text, at, min(length, len(text) - at))
            if same < length:                                # split the edge
                mid = _Node(kid.text, kid.lo, kid.lo + same)
                kid.lo += same
                mid.kids[kid.text[kid.lo]] = kid
                node.kids[text[at]] = kid = mid
            node, at = kid, at + same
        node.keys.append(key)
        if low is not None and (node.low is None or low < node.low):
            node.low = low

    def minima(self):
        """(key, smallest id) of every inserted key."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            for key in node.keys:
                yield key, node.low
            stack.extend(node.kids.values())


def smallest_ids(texts: DataFrame, target: int = TARGET) -> DataFrame:
    """key, low: for each row (key, low, text) the smallest low among rows of the same text."""
    def run(batches):
        trie = Trie()
        for batch in batches:
            for key, low, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                trie.insert(text, key, low)
        out: list[tuple] = []
        for pair in trie.minima():
            out.append(pair)
            if len(out) == 65536:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = with_prefixes(texts, target).repartitionByRange(max(1, -(-total // target)), "prefix")
    return arrow_map(ranges.select("key", "low", "text"), run, "key long, low long")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["key", "low"])


def failures(docs: DataFrame, window: int = WINDOW, target: int = TARGET) -> DataFrame:
    """doc_id, part, mask: one row per row of ``docs``; bit k of mask is set if filter k fails."""
    both = stored(masked_rows(docs, window), "audit-rows")
    rows = both.where("mask IS NOT NULL").select("key", "doc_id", "part", "mask")
    lows = stored(smallest_ids(both.where("mask IS NULL").select("key", "low", "text"), target), "audit-minima")
    copy = F.when(F.col("doc_id") > F.col("low"), 1 << 4).otherwise(0)
    return rows.join(lows, "key").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def _steps() -> list[tuple[int, int, list[str]]]:
    """(bit of the filter, bits of the filters before it, the orders in which that happens)."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in permutations(FILTERS):
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            found.setdefault((bit, before), []).append("".join(order))
            before |= bit
    return [(bit, before, orders) for (bit, before), orders in found.items()]


def audit(docs: DataFrame, labels: DataFrame, window: int = WINDOW, target: int = TARGET) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley:
    one row per source, order and step."""
    marks = stored(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")),
        "audit-labels")
    rows = stored(failures(docs, window, target), "audit-masks")
    named = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("id"), "left")
    bare = rows.where("doc_id IS NULL").withColumns({c: F.lit(None).cast("int") for c in ("good", "bad")})
    both = [x.select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad"))) for x in (named, bare)]
    groups = both[0].unionByName(both[1]).groupBy("part", "mask", "good", "bad").agg(F.count("*").alias("n"))

    steps = _steps()
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(bit).alias("bit"), F.lit(before).alias("before"))
                      for k, (bit, before, _) in enumerate(steps)))
    orders = F.array(*(F.array(*map(F.lit, names)) for *_, names in steps))
    cell = groups.select("*", F.explode(cells).alias("x")).select("part", "mask", "good", "bad", "n", "x.*")
    has = lambda bits: F.col("mask").bitwiseAND(bits) != 0
    own, late = has(F.col("bit")), has(F.col("before"))
    count = lambda when, n="n": F.sum(F.when(when, F.col(n) if isinstance(n, str) else n).otherwise(0))
    sums = cell.groupBy("part", "k", "bit", "before").agg(
        count(~own & ~late).alias("kept"), count(own & ~late).alias("removed"), count(own & late).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(own & ~late & (F.col("good") == 1)).alias("good_lost"),
        count(own & ~late & (F.col("bad") == 1)).alias("toxic_lost"),
        # of k failing filters each removes the document in 1 / k of the orders
        count(own, F.expr("n * (120 div greatest(bit_count(mask), 1))")).alias("shapley"))
    return sums.select("part", F.explode(F.element_at(orders, F.col("k") + 1)).alias("filter_order"),
                       (F.bit_count("before") + 1).cast("int").alias("step"), "kept", "removed", "redundant",
                       "unique_fails", "good_lost", "toxic_lost", "shapley")
