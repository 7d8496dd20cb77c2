import random
from collections import Counter
from itertools import permutations

import pytest

from yieldlens.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows (doc_id, text, source); the contract read literally."""
    texts = [(i, t or "", s or "") for i, t, s in rows]

    def fails(i, t):
        words = t.encode().split()
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
                "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)}

    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    found = [(i, s, fails(i, t)) for i, t, s in texts]
    out = set()
    for part in {s for _, s, _ in found}:
        here = [(i, f) for i, s, f in found if s == part]
        shapley, rows_ = Counter(), []
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                shapley[letter] += len(gone)
                rows_.append((letter, ("".join(order), step, len(left), len(gone),
                                       sum(f[letter] for _, f in here) - len(gone),
                                       sum(f[letter] and sum(f.values()) == 1 for _, f in here),
                                       sum(i in good for i in gone), sum(i in bad for i in gone))))
        out |= {(part, *r, shapley[letter]) for letter, r in rows_}
    return out


def result(df):
    return {tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                        "good_lost", "toxic_lost", "shapley").collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 49, 50, 60, 200]))) for _ in range(30)]
    base += ["A " * 60, "x" * 400, "x" * 400 + "y", "", "50 % of " + base[0], "É À Ü " + base[1].upper(), base[2] + "\x1cz\xa0"]
    rows = [(k, rng.choice(base), rng.choice(["a", "b", None, ""])) for k in range(120)]
    rows += [(3, base[5], "a"), (3, base[5], "a"), (None, base[5], "b"), (None, None, None), (200, None, "c")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 130, 2)] + [(4, 1, None), (None, 1, 1), (3, None, 1)]
    return rows, labels


@pytest.mark.parametrize("window,target", [(fa.WINDOW, fa.TARGET), (500, 200), (1, 1)])
def test_matches_brute_force(spark, corpus, window, target):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = result(fa.audit(docs, spark.createDataFrame(labels, LABELS), window, target))
    assert got == brute(rows, labels)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert result(fa.audit(odd_docs, labels)) == brute(rows, [])
    assert fa.audit(no_docs, labels).count() == 0


def test_prefixes_grow_until_they_part_texts(spark):
    common = "the same opening " * 40
    texts = [(k, common + str(k % 7) + "z" * (k % 5)) for k in range(70)] + [(99, ""), (100, "the same opening")]
    df = spark.createDataFrame([(k, None, t.encode()) for k, t in texts], "key long, low long, text binary")
    found = fa.with_prefixes(df, 5000).collect()
    assert len(found) == len(texts)
    by_text = {bytes(r.text): bytes(r.prefix) for r in found}
    assert all(t.startswith(p) for t, p in by_text.items())
    assert len({p for t, p in by_text.items() if len(t) > 600}) == 35


def test_trie_keeps_minima_of_nested_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 8))).encode() for _ in range(600)]
    texts += [b"a" * n for n in range(300)] + [b"a" * 200_000, b"a" * 100_000 + b"b"]
    trie, want = fa.Trie(), {}
    for k, t in enumerate(texts):
        low = rng.choice([None, rng.randint(0, 50)])
        trie.insert(t, k, low)
        want.setdefault(t, []).append(low)
    low = {t: min((x for x in ids if x is not None), default=None) for t, ids in want.items()}
    assert dict(trie.minima()) == {k: low[t] for k, t in enumerate(texts)}
