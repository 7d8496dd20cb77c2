import random

import public_tokenizers
from pyspark.sql import functions as F

from yieldlens.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def apply(text, edits):
    text = text or ""
    for e in edits:
        a = min(e["from_char"], len(text))
        text = text[:a] + e["put"] + text[min(max(e["to_char"], a), len(text)):]
    return text


def check(df):
    counter = T.counter_of(PATH)
    full = lambda t: len(counter.encoding.encode_ordinary(t))
    rows = df.select("doc_id", "text", T.sample_edits(F.col("text")).alias("edits")).collect()
    want = []
    for r in rows:
        after = apply(r.text, r.edits)
        want.append((r.doc_id, full(r.text or ""), full(after), len(r.text or ""), len(after), 3))
    got = T.apply_edits(df, T.sample_edits(F.col("text")), PATH).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    return got


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sum(r.recounted_chars for r in got) < 0.5 * 3 * sum(r.chars_after for r in got)


def test_stored_trees_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    with_trees = docs.join(T.build(docs, PATH).select("doc_id", "leaf_chars", "leaf_tokens"), "doc_id")
    plain, again = (sorted(map(tuple, T.apply_edits(d, T.sample_edits(F.col("text")), PATH, trees=True).collect()))
                    for d in (docs, with_trees))
    assert plain == again


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert T.apply_edits(no_docs, T.sample_edits(F.col("text")), PATH).collect() == []
    some = F.expr("array(null, named_struct('from_char', 99999999, 'to_char', null, 'put', null), "
                  "named_struct('from_char', -5, 'to_char', 2, 'put', 'x'))")
    got = T.apply_edits(odd_docs, some, PATH).collect()
    assert all(r.chars_after == max(r.chars_before - 2, 0) + 1 and r.n_edits == 2 for r in got)
    assert all(r.n_edits == 0 for r in T.apply_edits(odd_docs, F.lit(None), PATH).collect())


def test_random_edits(monkeypatch):
    draw, counter = random.Random(1), T.counter_of(PATH)
    parts = ["a", "b", " ", "  ", "\n", " \n", "'", "'s", "ll", "12", "!!", "ß", " x", "\t", "", ".", "word word"]
    for turn in range(1500):
        monkeypatch.setattr(T, "LEAF", draw.choice([1, 2, 4]))
        text = "".join(draw.choices(parts, k=draw.randrange(300 if turn % 10 else 5)))
        tree = T.Tree(*counter.leaves(text))
        for _ in range(3):
            a = draw.randrange(len(text) + 3)
            text, _ = T.edit(tree, text, a, a + draw.randrange(20), "".join(draw.choices(parts, k=draw.randrange(6))), counter)
            assert (tree.chars, tree.tokens) == (len(text), len(counter.encoding.encode_ordinary(text)))


def test_trees_follow_replacements(monkeypatch):
    """Leaves replaced by more or fewer, against a plain list; the tree is seldom made anew."""
    draw, grown = random.Random(2), []
    grow = T.Tree._grow
    monkeypatch.setattr(T.Tree, "_grow", lambda self, leaves: (grown.append(1), grow(self, leaves))[1])
    for n in (0, 1, 2, 7, 64, 300):
        plain = [(draw.randint(1, 9), draw.randint(1, 5)) for _ in range(n)]
        tree = T.Tree(*map(list, zip(*plain))) if n else T.Tree([], [])
        grown.clear()
        for turn in range(200):
            total = sum(c for c, _ in plain)
            a = draw.randint(0, total)
            lo, at = tree.find(a)
            i = next((k for k in range(len(plain)) if sum(c for c, _ in plain[:k + 1]) > a), len(plain))
            assert at == sum(c for c, _ in plain[:i])
            assert (tree.before(lo) is None) == (i == 0) and (i == 0 or tree.size(tree.before(lo)) == plain[i - 1][0])
            j, hi = i, lo
            for _ in range(draw.randint(0, 3)):
                if j < len(plain):
                    assert tree.size(hi) == plain[j][0]
                    j, hi = j + 1, tree.after(hi)
            new = [(draw.randint(1, 9), draw.randint(1, 5)) for _ in range(draw.randint(0, 4))]
            plain[i:j] = new
            tree.replace(lo, hi, *(map(list, zip(*new)) if new else ([], [])))
            assert list(zip(*tree.leaves())) == plain
            assert (tree.chars, tree.tokens) == (sum(c for c, _ in plain), sum(t for _, t in plain))
        if n >= 64:
            assert len(grown) < 30
