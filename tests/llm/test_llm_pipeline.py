from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from test_llm_decontaminate import expected as leaks
from test_llm_line_dedup import expected as line_rows
from test_llm_simhash import expected as fingerprint_rows
from tokenizers import Tokenizer

from yieldlens.llm import quality

SF = "/root/testdata/sf0.001"


def test_against_plain_python(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {d: t for d, t in texts.items() if quality._scores([t], model)[0] >= 0.3}
    texts = {d: t for d, _, _, t in line_rows(list(texts.items()))}
    texts = {d: texts[d] for d, _, first in fingerprint_rows(list(texts.items())) if d == first}
    bad = {d for d, _ in leaks(list(texts.items()), [(r.item_id, r.text) for r in items.collect()])}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items() if d not in bad}
    got, sequences = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert got == want
    assert all(n <= 2048 for n in sequences.values())


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
