import random

import numpy as np

from yieldlens.llm import decontaminate

SF = "/root/testdata/sf0.001"


def words(text):
    out = [w.lower().strip(decontaminate._MARKS) for w in (text or "").split()]
    return [w for w in out if w]


def least_edits(item, text):
    """Word edits between item and the nearest stretch of text, cell by cell in one column a word."""
    col = list(range(len(item) + 1))
    best = col[-1]
    for w in text:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(col[k] + 1, new[k - 1] + 1, col[k - 1] + (x != w)))
        col = new
        best = min(best, col[-1])
    return best


def expected(docs, items):
    out = set()
    for d, text in docs:
        w = words(text)
        have = set(w)
        for i, item in items:
            it = words(item)
            most = int(0.2 * len(it) + 1e-9)
            if len(it) >= 5 and sum(x in have for x in it) >= len(it) - most and least_edits(it, w) <= most:
                out.add((d, i))
    return out


def test_documents_against_all_windows(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.contaminated(docs, items).collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 0
    kept = {r.doc_id for r in decontaminate.clean(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_recall_on_edited_items(spark):
    draw = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    vocabulary = [w for _, t in items for w in t.split()]
    docs = []
    for k in range(300):
        _, text = items[k % len(items)]
        w = text.split()
        for _ in range(int(0.15 * len(words(text)))):
            at = draw.randrange(len(w))
            draw.choice([lambda: w.__setitem__(at, draw.choice(vocabulary)), lambda: w.pop(at),
                         lambda: w.insert(at, draw.choice(vocabulary))])()
        docs.append((k, " ".join([*draw.sample(vocabulary, 50), *w, *draw.sample(vocabulary, 50)])))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum((k, items[k % len(items)][0]) in {(r.doc_id, r.item_id) for r in found} for k in range(300)) >= 0.95 * 300


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "One two, THREE four five!"), (2, None), (3, ""), (4, "too short"),
                                   (None, "line that several documents share"), (1, "one two three four five")],
                                  "item_id long, text string")
    got = decontaminate.contaminated(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, None), (4, None), (None, None), (6, None)}
    assert decontaminate.contaminated(no_docs, items).collect() == []
    assert decontaminate.contaminated(odd_docs, none).collect() == []
    kept = decontaminate.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "7", "None"]


def test_several_blocks_of_items(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 700)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items).collect()} == whole


def test_edit_distance_is_exact():
    draw = random.Random(4)
    for _ in range(300):
        item, text = ([draw.randrange(1, 5) for _ in range(draw.randrange(1, n))] for n in (8, 20))
        want = least_edits(item, text)
        got, _ = decontaminate.edit_distance(np.array(item, np.uint64), np.array(text, np.uint64), 8)
        assert got == want


def test_a_passage_shared_by_many_items_is_listed_in_runs(monkeypatch):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(4000)}"
    passage = [word() for _ in range(12)]
    items = [(k, " ".join(passage + [word() for _ in range(8)])) for k in range(200)]
    docs = []
    for k in range(40):
        text = items[k * 5][1].split()
        text[draw.randrange(len(text))] = word()
        docs.append(" ".join([word() for _ in range(30)] + text + [word() for _ in range(25)] + passage))
    symbols = [decontaminate.symbols(d, decontaminate._Symbols()) for d in docs]
    block = decontaminate.Items(items, 0.8, 5, decontaminate.STRIDE)
    whole = list(block.matches(symbols))
    monkeypatch.setattr(decontaminate, "LISTED", 37)
    assert list(block.matches(symbols)) == whole
    assert {(d, i) for d, i, *_ in whole} == expected(list(enumerate(docs)), items)


def test_repeated_items_are_one_item(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")] * 50, "item_id long, text string")
    docs = spark.createDataFrame([(7, "zero one two three four five six seven eight nine")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(7, 1, 0)]
    assert decontaminate.clean(docs, items).count() == 0


def test_short_items_are_never_missed():
    draw = random.Random(6)
    word = lambda: f"w{draw.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(5 + k % 20))) for k in range(200)]
    docs = []
    for k, (_, text) in enumerate(items * 2):
        w = text.split()
        for _ in range(int(0.2 * len(w) + 1e-9) if k < 200 else 0):
            at = draw.randrange(len(w))
            draw.choice([lambda: w.__setitem__(at, word()), lambda: w.pop(at), lambda: w.insert(at, word())])()
        docs.append(" ".join([word() for _ in range(20 + k % 4)] + w + [word() for _ in range(20)]))
    block = decontaminate.Items(items, 0.8, 5, decontaminate.STRIDE)
    found = list(block.matches([decontaminate.symbols(d, decontaminate._Symbols()) for d in docs]))
    assert {(d, i) for d, i, *_ in found} == expected(list(enumerate(docs)), items)
    assert {(d, i, e) for d, i, e, _ in found} == {(d, i, least_edits(words(items[i][1]), words(docs[d])))
                                                   for d, i, *_ in found}


def test_items_of_few_words_and_scripts_without_spaces(spark):
    han = "春眠不覺曉，處處聞啼鳥。夜來風雨聲，花落知多少。"
    items = spark.createDataFrame([(1, "Quite short!"), (2, han), (3, "one"), (4, "สวัสดีครับ"), (5, "..."), (6, "鳥"),
                                   (7, "a b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "it is quite, SHORT here"), (2, "quite a short one"), (3, "前" + han.replace("啼", "蹄") + "後"),
                                  (4, "ก่อนสวัสดีครับ"), (5, "春眠 many 聞啼"), (6, "a b x c d a b c"), (7, "... !")],
                                 "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(1, 1, 0), (2, 3, 0), (3, 2, 1), (3, 6, 0), (4, 4, 0)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {5, 6, 7}
