"""WARC archives: rows through them against plain rules, the normaliser on streams of its own, ranges by the sidecar."""

import collections
import gzip
import hashlib
import io
import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import warc
from scanlake.llm.common import materialize

KINDS = "page_id long, url string, html string, n long, _row string, digest int"
BIG = "<p>ünï &amp; \r\n\r\n WARC/1.1\r\n</p>" * 50


def brute(rows):
    by, out = collections.defaultdict(list), []
    for page_id, _, html in rows:
        by[(html or "").encode()].append(page_id)
    for payload, ids in by.items():
        ids.sort(key=lambda x: (x is not None, x or 0), reverse=True)
        for i, page_id in enumerate(ids):
            again = len(payload) >= 1000 and i > 0
            out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return collections.Counter(out)


def some_rows():
    rows = [(i, f"http://h/{i} ü\r\nX: y%", [None, "", "small", BIG, BIG + "x", "é" * 499, "é" * 500][i % 7]) for i in range(200)]
    rows += rows[190:200] + [(None, None, BIG), (None, None, "alone" * 300), (None, None, "alone" * 300), (2**60 + 1, None, "y" * 3_000_000), (2**60, "u", "y" * 3_000_000)]
    return rows


def pages(spark, rows, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(*r, 1, "z", 2) for r in rows], KINDS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_awkward_rows(spark, tmp_path):
    rows = some_rows()
    pages(spark, rows, tmp_path)
    got = collections.Counter(tuple(r) for r in warc.op12_warc(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_empty(spark, tmp_path):
    pages(spark, [], tmp_path)
    assert warc.op12_warc(spark, str(tmp_path)).count() == 0


def test_hot_payloads_without_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, "u", BIG if i % 3 else BIG + str(i // 20)) for i in range(600)]
    df = pages(spark, rows, tmp_path).withColumn("_row", F.monotonically_increasing_id())
    groups = warc.revisited(df, 1000)
    want = warc.with_first(df, groups).select("page_id", "_first", "_first_row").collect()
    small = warc.small_side
    monkeypatch.setattr(warc, "small_side", lambda x: small(x) if x.count() < 5 else x)
    got = warc.with_first(df, groups, hot=100).select("page_id", "_first", "_first_row").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 600
    assert collections.Counter(r["_first"] is not None for r in want)[True] == 600


def test_archives_hold_whole_records(spark, tmp_path):
    """Each member of an archive is one record, at the sidecar's offset; the whole file is one gzip stream too; payloads come back."""
    rows = some_rows()
    folder = f"file://{tmp_path}/out"
    whole = warc.write(pages(spark, rows, tmp_path), folder, archive_bytes=100_000)
    assert whole.agg(F.sum("records")).first()[0] == len(rows) and whole.count() > 5
    for r in whole.collect():  # one member
        d = zlib.decompressobj(31)
        d.decompress(open(f"{tmp_path}/out/{r['archive']}", "rb").read())
        assert d.eof and not d.unused_data
    archives = warc.normalise(whole, folder)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) + whole.count()  # and a warcinfo each
    for r in archives.collect():
        raw = open(f"{tmp_path}/out/{r['archive']}", "rb").read()
        lines = [json.loads(x) for x in open(f"{tmp_path}/out/{r['sidecar']}")]
        assert [x["offset"] for x in lines] == np.cumsum([0, *(x["length"] for x in lines)])[:-1].tolist() and sum(x["length"] for x in lines) == len(raw)
        joined = b""
        for x in lines:
            d = zlib.decompressobj(31)
            joined += (record := d.decompress(raw[x["offset"] : x["offset"] + x["length"]]))
            assert d.eof and not d.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert record.partition(b"\r\n\r\n")[0].decode().count("\r\n") <= 11  # no line of a header comes from a url
        assert gzip.decompress(raw) == joined
    got = warc.read(warc.index(archives, folder), folder, payloads=True, range_bytes=1000).collect()
    texts = collections.Counter((r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response")
    assert sum(texts.values()) == sum(n for r, n in brute(rows).items() if r[3] == "response")
    assert all(x in {((p, (t or "").encode())) for p, _, t in rows} for x in texts)
    assert len({r["record_id"] for r in got}) == len(rows)


def test_normaliser_takes_any_stream():
    """One member or many, small pieces, records longer than a piece; a cut archive is an error."""
    records = [warc.info_record("2020-01-01T00:00:00Z")]
    for i, n in enumerate((0, 1, 7, 5000, 70_000)):
        records.append(b"".join(warc.page_record(i, i, None, bytes(range(256)) * (n // 256 + 1), "d", None, "2020-01-01T00:00:00Z")))
    single, several = gzip.compress(b"".join(records)), b"".join(gzip.compress(b"".join(records[a : a + 2])) for a in range(0, 6, 2))
    for raw in (single, several, b"".join(map(gzip.compress, records))):
        for size in (1, 17, 4096, 1 << 20):
            if size == 1 and raw is not single:
                continue
            out = io.BytesIO()
            found = list(warc.members(warc.Stream(io.BytesIO(raw), size), out.write, 6))
            data = out.getvalue()
            assert [gzip.decompress(data[r.offset : r.offset + r.length]) for r in found] == records
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(warc.Stream(io.BytesIO(gzip.compress(records[-1][:-50]))), io.BytesIO().write, 6))


def test_damage_is_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    os.makedirs(f"{tmp_path}/out")
    head, tail = warc.page_record(1, 0, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None, "d")
    with open(f"{tmp_path}/out/a.warc.gz", "wb") as f:
        f.write(raw := gzip.compress(head + tail))
    entries = materialize(spark.createDataFrame([("a.warc.gz", 0, len(raw), "response", "", "")], warc.SIDECAR), "entries")
    with pytest.raises(Exception, match="damaged"):
        warc.read(entries, folder).collect()
