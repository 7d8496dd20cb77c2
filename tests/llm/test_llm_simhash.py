import random
import re
from collections import defaultdict

import xxhash

from yieldlens.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, most):
    """fingerprint -> smallest fingerprint reachable, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    order = sorted(prints)
    for k, p in enumerate(order):
        for q in order[k + 1:]:
            if (p ^ q).bit_count() <= most:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in prints}


def expected(docs):
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    root = classes({f for _, f in prints}, 2)
    members = defaultdict(list)
    for i, f in prints:
        members[root[f]].append(i)
    low = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return sorted(((i, f"{f:016x}", low[root[f]]) for i, f in prints), key=str)


def check(df):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == expected(docs)


def test_documents_against_all_pairs(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_per_class(odd_docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 1, 2, 4, 5, 6]  # 1 leads two classes; 2, 3 and 7 have no words
    assert sum(r.doc_id is None for r in kept) == 2


def test_links_with_crowded_buckets(spark, monkeypatch):
    draw = random.Random(5)
    for most, bucket in ((0, 8), (1, 8), (2, 8), (2, 10 ** 6)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        prints = set()
        for _ in range(6):
            centre = draw.getrandbits(64)
            for _ in range(60):
                p = centre
                for _ in range(draw.randrange(5)):
                    p ^= 1 << draw.randrange(64)
                prints.add(p)
        signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
        fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
        comps = {r.node: r.root for r in simhash.connected_components(simhash.links(fps, most)).collect()}
        want = classes(prints, most)
        groups = defaultdict(set)
        for p in prints:
            groups[comps.get(signed[p], signed[p])].add(p)
        truth = defaultdict(set)
        for p in prints:
            truth[want[p]].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 2000), (2000, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 2000: 1000}


def test_the_kept_row_of_a_repeated_id_leads_its_class(spark):
    draw = random.Random(8)
    text = lambda: " ".join(f"w{draw.randrange(5000)}" for _ in range(60))
    rows, want = [], set()
    for k in range(0, 40, 2):
        shared, own = text(), text()
        rows += [(k, shared), *draw.sample([(k + 1, shared), (k + 1, own), (k + 1, shared)], 3)]
        want |= {shared, own}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = simhash.one_per_class(docs).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert {r.text for r in kept} == want


def test_an_id_may_lead_several_classes(spark):
    draw = random.Random(9)
    a, b, c, *more = (" ".join(f"w{draw.randrange(5000)}" for _ in range(60)) for _ in range(203))
    rows = [(5, a), (5, b), (7, b), (8, a), (9, c), *((1000, t) for t in more), *((1000, t) for t in more[:50]),
            *((2000 + k, t) for k, t in enumerate(more))]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [(r.doc_id, r.text) for r in simhash.one_per_class(docs).collect()]
    assert sorted(kept) == sorted([(5, a), (5, b), (9, c), *((1000, t) for t in more)])


def test_kept_texts_are_joined_alike_at_any_size(spark):
    """Disk use in proportion: a small table takes the same join of the texts with the leads as a large one."""
    rows = [(k, f"some words of text {k % 7} and {k % 3}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = simhash.one_per_class(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[doc_id#\d+L?\], \[__id#\d+L?\], LeftSemi", plan)
