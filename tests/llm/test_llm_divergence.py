import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from yieldlens.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, min_docs, top):
    """rows (text, lang, source)."""
    rows = [(TERM.findall(lower(t)), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in rows}:
        docs, counts, sources = Counter(), defaultdict(Counter), {s for _, g, s in rows if g == lang}
        for terms, g, s in rows:
            if g == lang:
                docs.update(set(terms))
                counts[s].update(terms)
                counts[None].update(terms)
        kept = [t for t, n in docs.items() if n >= min_docs]
        total = {s: sum(counts[s][t] for t in kept) for s in counts}
        rate = {s: {t: 1 + 10 ** 9 * (counts[s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in counts}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            p = rate[s]
            pairs = [(o, sum(f(p[t], rate[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[t], rate[None][t])) for t in kept if counts[s][t] and p[t] > rate[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, *x, k) for k, x in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["the", "The", "naïve", "Éa", "internationalisation", "internationalisations", "internationalise",
             "a" * 40, "a" * 41, "a" * 40 + "b", "don't", "x1y", "日本語", "ſ"] + [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 40))), lang, source))
    rows += [(None, "en", "silent"), ("", "xx", "s1"), ("12 34", "xx", "s2"), ("once", "yy", "s1"), ("The the THE", "en", "s1")]
    return rows


@pytest.mark.parametrize("min_docs,slice_,sources", [(10, dv.SLICE, dv.SOURCES), (2, 300, 2), (1, 40, 1)])
def test_matches_brute_force(spark, corpus, monkeypatch, min_docs, slice_, sources):
    monkeypatch.setattr(dv, "SLICE", slice_)
    monkeypatch.setattr(dv, "SOURCES", sources)
    docs = spark.createDataFrame(corpus, "text string, lang string, source string").repartition(3)
    assert result(dv.audit(docs, min_docs, 5)) == brute(corpus, min_docs, 5)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert result(dv.audit(odd_docs, 1)) == brute(rows, 1, 10)
    assert dv.audit(no_docs).count() == 0


def test_long_text_is_one_document(spark):
    rows = [("alpha beta " * 2_000_000 + "gamma", "en", "s1"), ("alpha", "en", "s2"), ("gamma gamma", "en", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    counts, found = Counter(), Counter()
    for r in dv.slice_counts(docs).collect():
        found[r.term] += r.docs
        counts.update({(s, r.term): n for s, n in zip(r.sources, r.ns)})
    assert counts["s1", "alpha"] == 2_000_000 and counts["s1", "gamma"] == 1 and counts["s2", "gamma"] == 2
    assert found == {"alpha": 2, "beta": 1, "gamma": 2}


@pytest.mark.parametrize("small", [1, 7, 8192])
def test_pointer_sort(monkeypatch, small):
    monkeypatch.setattr(dv, "SMALL", small)
    rng = random.Random(small)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(900)] + ["b" * n for n in range(1, 70)] + ["the"] * 300
    words += ["x" * 100 + str(k % 3) for k in range(20)] + ["é" * 50]
    rng.shuffle(words)
    text = " ".join(words).encode()
    data = np.frombuffer(text, np.uint8)
    pointers, lengths = dv.word_starts(data, np.array([0]))
    found = [text[p:p + n] for p, n in zip(pointers, lengths)]
    assert found == [m.encode() for m in TERM.findall(text.decode())]
    sort = dv.PointerSort(data, pointers, lengths)
    ordered = [found[k] for k in sort.order]
    assert ordered == sorted(found)
    assert sort.first.tolist() == [k == 0 or ordered[k] != ordered[k - 1] for k in range(len(ordered))]
    runs = np.cumsum(sort.first)
    assert all(a < b for a, b, r, s in zip(sort.order, sort.order[1:], runs, runs[1:]) if r == s)   # stable
