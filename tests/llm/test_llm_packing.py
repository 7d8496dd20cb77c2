import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from yieldlens.llm import packing
from yieldlens.llm.tokens import WordTokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, with_ids=False):
    tokenizer = Tokenizer.from_file(PATH)
    truth = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        truth[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    pieces = packing.pack_documents(df, PATH, with_ids=True).collect()
    sequences, covered = defaultdict(list), defaultdict(int)
    for p in pieces:
        same = [ids for ids in truth[p.doc_id] if len(ids) == p.doc_tokens and ids[p.start:p.start + p.length] == p.ids]
        assert same and p.length > 0
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        sequences[p.sequence_id].append(p)
        covered[p.doc_id] += p.length
    assert covered == {d: sum(map(len, x)) for d, x in truth.items()}
    starts = sorted((str(p.doc_id), p.start) for p in pieces)
    for doc, versions in truth.items():
        if len(versions) == 1:
            mine = sorted((p.start, p.length) for p in pieces if p.doc_id == doc)
            assert [s for s, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]]
    assert len(starts) == len(pieces)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1].tolist()]
        total = sum(p.length for p in s)
        assert total == s[0].window <= 2048 and total & (total - 1) == 0          # no padding at all
    return pieces


def test_documents_round_trip(spark):
    pieces = check(spark.read.parquet(f"{SF}/documents.parquet").repartition(3))
    totals = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length == p.window == 2048 for p in pieces) >= sum(n // 2048 for n in totals.values()) > 0


def test_odd_rows(odd_docs, no_docs, monkeypatch):
    check(odd_docs)
    monkeypatch.setattr(packing, "POOL", 500)
    check(odd_docs)
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_step_groups_are_balanced():
    windows, rest = packing.pack([3000, 900, 40, 700, 5000, 300, 300, 2048, 1024] * 40)
    groups = packing.step_groups([s for s, _ in windows], 16 * 2048)
    sums = defaultdict(int)
    for (size, _), g in zip(windows, groups):
        sums[g] += size
    assert max(sums.values()) - min(sums.values()) <= 2048 and sum(p.length for p in rest) < 256


def test_tokens_equal_the_library():
    mine, theirs = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = ["don't l'été İstanbul ΣΑΣ 12,5 a<|endoftext|>b é́ é naïve_x ﬁ x y z \x1cq 'S it's! ½ ʼn ǅ 中文 😀😀!? ǀx",
             "", "   ", "a.b ,'ll x.'s A.B. (x.) ÷a× µ", "<|startoftext|> a. <|STARTOFTEXT|>", "One. Two, three", "a\x85b\nc\td"]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_every_latin_mark_beside_a_stop():
    mine, theirs = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for c in map(chr, range(256)):
        for s in ".,":
            for t in (f"foo{c}{s} bar", f"foo{s}{c} bar", f"a {c}{s}b, x", f"a{s}{c}{s}b", f"a {s}{c}", f"{c}{s}"):
                ids = np.frombuffer(mine.encode(t), "<u4").tolist()
                assert ids == theirs.encode(t, add_special_tokens=False).ids, repr(t)
