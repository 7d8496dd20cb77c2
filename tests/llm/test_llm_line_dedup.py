import re
import time

from yieldlens.llm import line_dedup

SPACE = " \t\n\x0b\f\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def expected(docs):
    order = lambda d: (d is None, d or 0)
    owner = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= 10 and (k not in owner or order(d) < order(owner[k])):
                owner[k] = d
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(df, **how):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(df, **how).collect()), key=str)
    assert got == expected(docs)


def test_documents_in_batches(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for batches in (1, 2, 7):
        check(df, batches=batches)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert line_dedup.dedup_lines(no_docs).collect() == []
    out = line_dedup.without_copied_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_line_in_a_third_of_the_documents(spark):
    check(spark.createDataFrame([(k, f"own line number {k}\n" + ("the line of many\n" * 2 if k % 3 else ""))
                                 for k in range(600)], "doc_id long, text string"))


def test_levels_merge(spark):
    runs = line_dedup.Runs(spark)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, k, k)], "h1 long, h2 long, owner long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r.h1 for run in runs.all() for r in run.collect()) == [0, 1, 2, 3, 4]


def test_no_python_in_the_plan(spark):
    df = line_dedup.dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_of_many_lines_take_linear_time(spark):
    """Two texts of 200,000 equal lines but for ten: the second loses them all, in time linear in the lines."""
    lines = [f"a line that is long enough, number {k}" for k in range(200_000)]
    other = [*lines[:100_000], *(f"only in the second text {k}" for k in range(10)), *lines[100_000:]]
    rows = [(1, "\n".join(lines)), (2, "\n".join(other)), (None, "\n".join(lines[:50_000])), (None, "short\n" + lines[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - start < 60
    assert got[1, 200_000].n_dropped == 0
    assert got[2, 200_010].n_dropped == 200_000 and got[2, 200_010].text.count("\n") == 9
    assert got[None, 50_000].n_dropped == 50_000 and got[None, 2].text == "short"
