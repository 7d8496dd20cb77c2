import io
import struct
import zipfile

import pytest

from yieldlens.llm import warc
from yieldlens.llm.common import new_folder


class Memory:
    def __init__(self, raw):
        self.raw, self.size = raw, len(raw)

    def read(self, at, n):
        return self.raw[at:at + n]


def archive(comment=b"", wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("a", b"first"), ("dir/b", b"second" * 100)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(data)
        z.writestr("packed", b"x" * 500, zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("raw", [archive(), archive(b"PK\x05\x06 a comment"), archive(wide=True)])
def test_stored_members(raw):
    file = Memory(raw)
    assert {n: file.read(*x) for n, x in warc.members(file).items()} == {"a": b"first", "dir/b": b"second" * 100}


def test_zip64_directory():
    raw = archive()
    at = raw.rfind(b"PK\x05\x06")
    n, size, offset = struct.unpack_from("<HII", raw, at + 10)
    # the entries' offsets and sizes go to ZIP64 fields, the end record to its ZIP64 form
    directory, k = b"", offset
    for _ in range(n):
        head = bytearray(raw[k:k + 46])
        name_n = struct.unpack_from("<H", head, 28)[0]
        packed, plain = struct.unpack_from("<II", head, 20)
        local = struct.unpack_from("<I", head, 42)[0]
        extra = struct.pack("<HHQQQ", 1, 24, plain, packed, local)
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", head, 30, len(extra))
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        directory += bytes(head) + raw[k + 46:k + 46 + name_n] + extra
        k += 46 + name_n + struct.unpack_from("<H", raw, k + 30)[0]
    end = offset + len(directory)
    wide = (raw[:offset] + directory
            + struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), offset)
            + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
            + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    file = Memory(wide)
    assert file.read(*warc.members(file)["a"]) == b"first"


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        warc.members(Memory(b"not an archive" * 10))
    good = warc.record("response", 1, "u", b"payload", warc.payload_digest(b"payload"), None)
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_payloads_come_back(spark):
    schema = "page_id long, url string, html string, sha1 string, first long, payload binary"
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "u", ""),
            (None, "u", "<p>é</p>"), (None, "v", "alone"), (1, "b b", "a\r\n\r\nb" * 1000)]
    pages = spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema)
    listed = warc.write_archives(pages, new_folder(spark, "warc-test"))
    got = warc.read_archives(listed).collect()
    key = lambda x: str(x)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=key) == sorted([
        (5, "revisit", 3, 9), (3, "response", None, 9), (3, "response", None, 9), (9, "revisit", 8, 0),
        (8, "response", None, 0), (None, "revisit", 3, 9), (None, "response", None, 5), (1, "response", None, 6000)], key=key)
    texts = {r[0]: (r[2] or "").encode() for r in rows if r[0]}
    for r in got:
        if r.page_id:
            assert r.payload_digest == warc.payload_digest(texts[r.page_id])
            assert r.payload == (texts[r.page_id] if r.record_type == "response" else None)
    small = warc.write_archives(pages, new_folder(spark, "warc-test"), min_bytes=10)
    assert {r.record_type for r in warc.read_archives(small).collect()} == {"response"}
    empty = warc.write_archives(pages.limit(0), new_folder(spark, "warc-test"))
    assert warc.read_archives(empty).collect() == []


def test_archives_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").coalesce(1)
    listed = warc.write_archives(pages, new_folder(spark, "warc-test"))
    assert listed.count() >= 1
    assert {r.page_id for r in warc.read_archives(listed, payloads=False).collect()} == {r.page_id for r in pages.collect()}
