"""Source divergence audit by token-start pointer sort.

How the sources of a language differ in the terms they use: terms are runs of letters and non-ASCII
characters, and each language keeps those in at least ``min_docs`` of its documents.

Method. In every task the texts of a slice of ``SLICE`` bytes stay in one Arrow buffer, and a pointer is
built to each word start. The pointers are sorted by the words they point at with a multikey
quicksort that compares eight bytes at a depth: a slice of pointers is split into smaller, equal and
greater ones than a pivot, equal ones go on eight bytes deeper, and slices of up to ``SMALL`` pointers are
sorted at once. Pointers of one word then form an equal run, whose documents and counts per
source are read off, one row a run and language. These rows meet by language and term in the only shuffle of all terms;
those of terms in too few documents end there.

Pairs of sources are compared in tasks by language, bucket of terms and block of sources, as the
integer sums of their matrix of rates; the buckets' sums are added by Spark.

Edge cases: null text, lang and source are empty; groups without terms take part; a language
without kept terms gives its pairs with value 0; every row of ``docs`` is a document, whatever its
doc_id; a text longer than a slice is cut between words and counted as one document; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, importable, slices, stored

MIN_DOCS = 10
TOP = 10                 # terms reported for a group
SLICE = 8 << 20          # bytes of text whose pointers are sorted together
SMALL = 8192             # pointers sorted without another split
DEEP = 4                 # eight-byte keys compared at once in such a slice
TERMS = 1 << 14          # terms of a bucket, about
SOURCES = 256            # sources of a block
UNIT = 1_000_000_000     # rates are in billionths

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MASKS = np.array([(1 << 64) - (1 << 8 * k) for k in range(9)], np.uint64)      # without the last k bytes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to the words of the bytes ``data``, and their lengths; a new text begins at each of ``starts``."""
    letter = _LETTER[data]
    new = np.empty(len(data) + 1, bool)                      # a word, or the gap after it, begins here
    new[0] = new[-1] = True
    new[1:-1] = letter[1:] != letter[:-1]
    new[starts[starts < len(data)]] = True
    edges = np.flatnonzero(new).astype(np.int32)
    words = letter[edges[:-1]]
    return edges[:-1][words], np.diff(edges)[words]


class PointerSort:
    """Sorts pointers by the words they point at; equal words keep their order."""

    def __init__(self, data: np.ndarray, pointers: np.ndarray, lengths: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.windows = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
        self.pointers, self.lengths = pointers, lengths
        self.order = np.arange(len(pointers), dtype=np.int32)
        self.first = np.zeros(len(pointers), bool)           # where an equal run begins
        if len(pointers):
            self._sort()

    def _keys(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes of each word at a depth, zeros after its end."""
        unused = np.clip(8 * (depth + 1) - self.lengths[which], 0, 8)
        at = np.minimum(self.pointers[which] + 8 * depth, len(self.windows) - 1)
        return self.windows[at].astype(np.uint64) & _MASKS[unused]

    def _sort(self) -> None:
        order, lengths, first = self.order, self.lengths, self.first
        held = self._keys(order, 0)                          # of each place the key at its slice's depth
        todo = [(0, len(order), 0)]
        while todo:
            lo, hi, depth = todo.pop()
            first[lo] = True
            if hi - lo == 1:
                continue
            here, keys = order[lo:hi], held[lo:hi]
            if hi - lo > SMALL:
                some = np.sort(keys[::(hi - lo) // 101 + 1])
                pivot = some[len(some) // 2]
                less, more = keys < pivot, keys > pivot
                equal = ~(less | more)
                a, b = lo + int(less.sum()), hi - int(more.sum())
                order[lo:hi] = np.concatenate([here[less], here[equal], here[more]])
                held[lo:hi] = np.concatenate([keys[less], keys[equal], keys[more]])
                if lo < a:
                    todo.append((lo, a, depth))
                if b < hi:
                    todo.append((b, hi, depth))
                first[a] = True
                if (lengths[order[a:b]] > 8 * depth + 8).any():
                    held[a:b] = self._keys(order[a:b], depth + 1)
                    todo.append((a, b, depth + 1))
                continue
            longest = int(lengths[here].max())
            deep = max(1, min(DEEP, -(-longest // 8) - depth))
            keys = [keys, *(self._keys(here, depth + k) for k in range(1, deep))]
            by = np.lexsort(keys[::-1])
            order[lo:hi] = here = here[by]
            new = np.zeros(hi - lo, bool)
            new[0] = True
            for k in keys:
                k = k[by]
                new[1:] |= k[1:] != k[:-1]
            first[lo:hi] |= new
            if longest > 8 * (depth + deep):                 # runs equal so far whose words go on
                edges = np.append(np.flatnonzero(new), hi - lo)
                goes_on = np.maximum.reduceat(lengths[here], edges[:-1]) > 8 * (depth + deep)
                for i in np.flatnonzero(goes_on & (np.diff(edges) > 1)).tolist():
                    i, j = int(edges[i]), int(edges[i + 1])
                    held[lo + i:lo + j] = self._keys(here[i:j], depth + deep)
                    todo.append((lo + i, lo + j, depth + deep))


def _words(data: np.ndarray, pointers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words as an Arrow array."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    at = np.repeat(pointers - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pointers), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _runs(data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, and of each word and group the place of the word, the group, occurrences and documents) of the texts that
    begin at ``starts`` in ``data``, by word and group."""
    data = _LOWER[data]
    pointers, lengths = word_starts(data, starts)
    sort = PointerSort(data, pointers, lengths)
    heads = sort.order[sort.first]
    words = _words(data, pointers[heads], lengths[heads])
    run = np.cumsum(sort.first) - 1
    row = (np.searchsorted(starts, pointers, "right") - 1).astype(np.int32)[sort.order]
    n_groups = int(groups.max(initial=0)) + 1
    cell = run * n_groups + groups[row]
    del pointers, lengths, sort
    new = np.ones(len(run), bool)                            # the first place of a document in a run
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    cells, at, counts = np.unique(cell, return_inverse=True, return_counts=True)
    return words, cells // n_groups, cells % n_groups, counts, np.bincount(at[new], minlength=len(cells))


def slice_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs, sources, ns: of each slice, the documents that a language's texts hold a term in, and its
    occurrences in each source."""
    schema = "lang string, term string, docs long, sources array<string>, ns array<long>"

    def emit(texts, langs, sources, once=None):
        """The counts of binary ``texts``; ``once`` holds the terms of this document that were counted before."""
        texts = pa.concat_arrays(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        full = np.diff(offsets) > 0                          # empty texts have no words, nor a start of their own
        langs, sources = pa.concat_arrays(langs), pa.concat_arrays(sources)
        codes = [x.dictionary_encode().indices.to_numpy().astype(np.int64) for x in (langs, sources)]
        _, place, groups = np.unique(codes[0] * len(langs) + codes[1], return_index=True, return_inverse=True)
        words, word, group, counts, found = _runs(data, (offsets[:-1] - offsets[0])[full], groups[full])
        if not len(word):
            return
        if once is not None:
            seen = words.to_pylist()
            found = np.array([w not in once for w in seen], np.int64)
            once.update(seen)
        lang = codes[0][place][group]                        # groups are in the order of their languages
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (lang[1:] != lang[:-1])))
        found = np.add.reduceat(found, first)
        edges = np.append(first, len(word))
        for lo in range(0, len(first), 1 << 17):
            hi = min(lo + (1 << 17), len(first))
            cells = slice(edges[lo], edges[hi])
            offs = pa.array(edges[lo:hi + 1] - edges[lo], pa.int32())
            own = pa.array(place[group[cells]])
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(place[group[first[lo:hi]]])),
                 words.take(pa.array(word[first[lo:hi]])).cast(pa.binary()).cast(pa.string()),
                 pa.array(found[lo:hi], pa.int64()), pa.ListArray.from_arrays(offs, sources.take(own)),
                 pa.ListArray.from_arrays(offs, pa.array(counts[cells], pa.int64()))],
                ["lang", "term", "docs", "sources", "ns"])

    def pieces(text: bytes):
        """``text`` cut between words, about a slice each."""
        data, lo = np.frombuffer(text, np.uint8), 0
        while lo < len(text):
            hi = min(lo + SLICE, len(text))
            while hi < len(text) and _LETTER[data[hi]]:
                rest = np.flatnonzero(~_LETTER[data[hi:hi + 65536]])
                hi = hi + int(rest[0]) if len(rest) else min(hi + 65536, len(text))
            yield text[lo:hi]
            lo = hi

    def run(batches):
        held, size = [], 0
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
            texts = batch.column(2).cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            if sizes.max(initial=0) > SLICE:
                for k in np.flatnonzero(sizes > SLICE).tolist():
                    once: set[bytes] = set()
                    for piece in pieces(texts[k].as_py()):
                        yield from emit([pa.array([piece], pa.large_binary())], [batch.column(0)[k:k + 1]],
                                        [batch.column(1)[k:k + 1]], once)
                keep = pa.array(sizes <= SLICE)
                batch, texts = batch.filter(keep), texts.filter(keep)
            if len(texts):
                held.append((texts, batch.column(0), batch.column(1)))
                size += int(sizes[sizes <= SLICE].sum())
            if size >= SLICE:
                yield from emit(*map(list, zip(*held)))
                held, size = [], 0
        if held:
            yield from emit(*map(list, zip(*held)))

    return arrow_map(_groups(docs, "text"), run, schema)


def _groups(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", *more)))


def _rate(count: str, total: str) -> F.Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact."""
    return F.expr(f"1 + cast({UNIT} as decimal(12,0)) * ({count} + 2) div ({total} + 2 * terms)").cast("long")


def _differ(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def pair_sums(counts: DataFrame, totals: DataFrame, n_buckets: int) -> DataFrame:
    """lang, source, item, value for the pairs of sources of a language with terms. ``counts`` is (lang, source, term, n)
    of the kept terms, ``totals`` (lang, source, total, terms, place): place numbers the language's sources."""
    def block(key, rows):
        kind = rows.column("term").is_null().to_numpy(zero_copy_only=False)
        base = rows.filter(pa.array(kind))                   # one row a source
        order = np.argsort(base.column("place").to_numpy())
        names = base.column("source").take(pa.array(order))
        zero = base.column("p").to_numpy()[order]            # the rate of a term that the source lacks
        used = rows.filter(pa.array(~kind))
        term = used.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        place, rate = used.column("place").to_numpy(), used.column("p").to_numpy()
        n_terms, size = int(term.max(initial=-1)) + 1, len(zero)
        lo = int(key[2].as_py()) * SOURCES
        hi = min(lo + SOURCES, size)
        sums = np.zeros((hi - lo, size), np.int64)
        by = np.argsort(term, kind="stable")
        term, place, rate = term[by], place[by], rate[by]
        step = max(1, (1 << 20) // max(1, size))
        for t in range(0, n_terms, step):
            i, j = np.searchsorted(term, [t, t + step])
            p = np.tile(zero, (min(step, n_terms - t), 1))
            p[term[i:j] - t, place[i:j]] = rate[i:j]
            for a in range(lo, hi):
                q = p[:, a:a + 1]
                sums[a - lo] += ((q - p) ** 2 // (q + p)).sum(axis=0)
        a, b = np.divmod(np.arange(sums.size), size)
        keep = a + lo != b
        a, b = pa.array(a[keep] + lo), pa.array(b[keep])
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": names.take(a),
                         "item": names.take(b), "value": sums.ravel()[keep]})

    importable(counts.sparkSession)
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / SOURCES).cast("int"))).alias("block")
    bucket = F.pmod(F.xxhash64("term"), F.lit(n_buckets))
    sources = totals.groupBy("lang").agg(F.count("*").alias("sources"))
    terms = counts.join(totals, ["lang", "source"]).select(
        "lang", "source", "place", "term", _rate("n", "total").alias("p"), bucket.alias("bucket"))
    used = stored(terms, "divergence-rates")
    none = (used.select("lang", "bucket").distinct().join(totals, "lang")
            .select("lang", "source", "place", F.lit(None).cast("string").alias("term"), _rate("0", "total").alias("p"), "bucket"))
    both = used.unionByName(none).join(sources, "lang").select("lang", "bucket", blocks, "source", "place", "term", "p")
    return (both.groupBy("lang", "bucket", "block").applyInArrow(block, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` compares a source with each other one of its language,
    part ``term`` lists the ``top`` terms that the source uses more than its language."""
    groups = stored(_groups(docs).distinct(), "divergence-groups")
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    cells = (slice_counts(docs).withColumn("docs", everywhere).where(F.col("docs") >= min_docs)
             .select("lang", "term", F.explode(F.arrays_zip("sources", "ns")).alias("x")))
    counts = stored(cells.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.ns").alias("n")),
                    "divergence-counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "divergence-terms")
    counts = counts.join(kept, ["lang", "term"])

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = (groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total"))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    totals = stored(totals.withColumn("place", place), "divergence-groups")

    n_buckets = max(1, -(-kept.count() // TERMS))
    sums = pair_sums(counts.select("lang", "source", "term", "n"), totals, n_buckets)
    other = totals.select("lang", F.col("source").alias("item"))
    pairs = (totals.select("lang", "source").join(other, "lang").where("source <> item")
             .join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    rates = (counts.join(totals, ["lang", "source"])
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     _rate("n", "total").alias("p"), _rate("lang_n", "lang_total").alias("q"))
             .where("p > q").select("lang", "source", "part", "item", _differ("p", "q").alias("value")))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).unionByName(ranked(rates).where(F.col("rank") <= top))
