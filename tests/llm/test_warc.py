import base64
import hashlib

import zstandard

from pawprint.llm.common import scratch
from pawprint.llm.queries import QUERIES
from pawprint.llm.warc import FRAME_BYTES, Bundle, get_record, read_bundles, write_bundles


def brute(rows, least=0):
    first, out = {}, []
    for i, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        p = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        known = first.setdefault(p, i) if len(p) >= least else i
        out.append((i, len(p), digest, "response" if known == i else "revisit", None if known == i else known))
    return out


def test_query(spark, small):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op4_warc"](spark, small).collect())) == brute(rows)


def test_edges(spark):
    html = ["same", "", None, "x" * 50_000, "é日", "same", "tiny", "tiny"]
    rows = [(i * 3 - 40, f"http://e/{i}\r\nX: y" if i % 2 else None, html[i % 8] + ("" if i % 8 in (0, 5, 6, 7) else str(i)) if html[i % 8] else html[i % 8], i) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int").repartition(7)
    for least in (0, 5):
        bundles = write_bundles(pages, scratch(spark, "warc-test"), revisit_bytes=least)
        got = read_bundles(bundles, with_payload=True).collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute([(r[0], r[2]) for r in rows], least)
        whole = {r[0]: (r[2] or "").encode() for r in rows}
        assert all(r.payload == whole[r.page_id] for r in got if r.record_type == "response")
    path = bundles.first().path
    with open(path.removeprefix("file://"), "rb") as f:  # any Zstandard reader can read it as one stream
        text = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    ids = [int(x.split(b">")[0]) for x in text.split(b"WARC-Record-ID: <urn:pawprint:page:")[1:]]
    assert get_record(path, ids[-1])["page_id"] == ids[-1] and get_record(path, 10**9) is None
    twice = spark.createDataFrame([(5, "u", "a"), (5, "u", "a"), (None, "u", "a")], "page_id bigint, url string, html string")
    got = read_bundles(write_bundles(twice, scratch(spark, "warc-test"))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("5", "response", None), ("5", "revisit", 5), ("None", "revisit", 5)]
    assert read_bundles(write_bundles(pages.limit(0), scratch(spark, "warc-test"))).count() == 0


def test_frames_hold_several_records(spark):
    rows = [(i, "u", f"page {i} " + "x" * (FRAME_BYTES * 2 if i == 50 else i * 40)) for i in range(300)]
    bundles = write_bundles(spark.createDataFrame(rows, "page_id bigint, url string, html string"), scratch(spark, "warc-test")).collect()
    assert sum(b.records for b in bundles) == 300
    for b in bundles:
        path = b.path.removeprefix("file://")
        with open(path, "rb") as f:
            bundle = Bundle(f, f.seek(0, 2))
            assert len(bundle.places) < len(bundle.map) and any(at for _, _, at in bundle.map)
            assert all(whole <= FRAME_BYTES or sum(m[1] == i for m in bundle.map) == 1 for i, (_, _, whole) in enumerate(bundle.places))
            assert all(bundle.get(i)["payload"] == rows[i][2].encode() for i, _, _ in bundle.map)


def test_identifier_with_two_shared_payloads(spark):
    rows = [(5, "u", "a"), (5, "u", "b"), (6, "u", "a"), (7, "u", "b"), (5, "u", "b")]
    got = read_bundles(write_bundles(spark.createDataFrame(rows, "page_id bigint, url string, html string"), scratch(spark, "warc-test")), with_payload=True).collect()
    assert sorted(r.payload for r in got if r.record_type == "response") == [b"a", b"b"]
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(5, 5), (6, 5), (7, 5)]
