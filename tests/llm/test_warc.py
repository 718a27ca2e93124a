import base64
import gzip
import hashlib
import re
import zlib

import pytest

from docloom.llm import warc

ROWS = [(1, "http://a.b/c d", "<p>x\n\ny</p>"), (2, None, "<p>x\n\ny</p>"), (3, "u", None), (4, "v", ""), (5, "w", "é" * 5000), (6, "z", "WARC/1.1\r\n\r\nhttp://x 0.0.0.0 1 t 5\n"), (5, "w", "é" * 5000), (None, "n", "q")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(spark, table, tmp_path, version):
    pages = table([(*r, "z") for r in ROWS], "page_id long, url string, html string, payload string", "pages")
    warc.write_arc(pages, str(tmp_path / "arc"), version)
    got = sorted((r.page_id or 0, bytes(r.block[len(r.block) - r.payload_bytes :])) for r in warc.read_arc(spark, str(tmp_path / "arc")).collect())
    assert got == sorted((i or 0, (h or "").encode()) for i, _, h in ROWS)


def test_records(spark, table):
    pages = table(ROWS, "page_id long, url string, html string", "pages")
    got = {}
    for r in warc.resolved(warc.archive_pages(pages)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got) == 7 and len(got[5]) == 2
    for i, _, html in ROWS:
        data = (html or "").encode()
        r = got[i][0]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    kinds = {i: (rs[0].record_type, rs[0].refers_to) for i, rs in got.items()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}


def foreign(version):
    """An archive of another writer: its own heads, a name lookup, a block without a head, a blank in a url."""
    head = lambda url, kind, block: f"{url} 10.0.0.1 19970102 {kind} ".encode() + (b"404 abc - 12 x.arc " if version == 2 else b"") + b"%d\n" % len(block) + block + b"\n"
    about = f"{version} 0 Other\n{warc.ARC_FIELDS[version]}\n".encode()
    blocks = {
        "http://a.b/gone": b"HTTP/1.0 404 Not Found\r\nServer: old\r\nContent-Type: text/plain\r\n\r\nnot\n\r\n\r\nhere\xff\x00",
        "http://a.b/old style": b"HTTP/1.0 200 OK\nServer: older\n\nbody",
        "dns:a.b": b"19970102\na.b. 60 IN A 10.0.0.1\n",
        "http://a.b/bare": b"no head at all",
        "http://a.b/cut": b"HTTP/1.0 204 No Content\r\n",
    }
    return blocks, b"filedesc://x.arc 0.0.0.0 19970102 text/plain " + (b"200 - - 0 x.arc " if version == 2 else b"") + b"%d\n" % len(about) + about + b"\n" + b"".join(head(u, "text/dns" if u[0] == "d" else "text/html", b) for u, b in blocks.items())


@pytest.mark.parametrize("version", [1, 2])
def test_archived_blocks_are_carried_byte_for_byte(spark, tmp_path, version):
    blocks, data = foreign(version)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/x.arc.gz").write_bytes(gzip.compress(data))
    warc.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    for url, block in blocks.items():
        at = whole.index(b"WARC-Target-URI: %s\r\n" % url.replace(" ", "%20").encode())
        begin = whole.index(b"\r\n\r\n", at) + 4
        assert b"Content-Length: %d" % len(block) in whole[at:begin] and whole[begin : begin + len(block)] == block
    assert whole.count(b"WARC-Type: warcinfo") >= 1 and b"WARC-Date: 1997-01-02T00:00:00Z" in whole and b"Content-Type: text/dns" in whole
    got = {r.url: (r.record_type, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert got["http://a.b/gone"] == ("response", b"not\n\r\n\r\nhere\xff\x00") and got["http://a.b/old%20style"] == ("response", b"body")
    assert got["dns:a.b"] == ("resource", blocks["dns:a.b"]) and got["http://a.b/bare"] == ("resource", b"no head at all") and got["http://a.b/cut"] == ("response", b"")


def test_each_revisit_names_its_response_by_identifier(spark, table, tmp_path):
    pages = table([(i, f"http://h/{i}", f"payload {i % 7}") for i in range(60)] + [(59, "http://h/again", "payload 3")], "page_id long, url string, html string", "pages")
    records = {}
    for r in warc.archive_pages(pages, str(tmp_path / "kept")).collect():
        assert r.record_id not in records
        records[r.record_id] = r
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "kept/warc").glob("*.gz")).decode()
    assert len(records) == 61 and "WARC-Concurrent-To" not in whole
    for r in records.values():
        if r.record_type == "revisit":
            led = records[r.refers_to_id]
            assert led.record_type == "response" and led.payload_digest == r.payload_digest and led.page_id > r.page_id
            head = whole[whole.index(f"WARC-Record-ID: {r.record_id}") :].partition("\r\n\r\n")[0]
            assert f"WARC-Refers-To-Target-URI: {led.url}\r\n" in head and f"WARC-Refers-To-Date: {led.date}\r\n" in head
    infos = set(re.findall(r"WARC-Type: warcinfo\r\nWARC-Record-ID: (\S+)", whole))
    assert infos and set(re.findall(r"WARC-Warcinfo-ID: (\S+)", whole)) == infos


def test_very_long_payloads_and_clashing_columns(spark, table):
    long = "x y\n" * 700_000
    pages = table([(1, "a", long, "c", b"d"), (2, "b", long, "c", b"d")], "page_id long, url string, html string, record_id string, block binary", "pages")
    got = {r.page_id: r for r in warc.resolved(warc.archive_pages(pages)).collect()}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {1: (2_800_000, "revisit", 2), 2: (2_800_000, "response", None)}


def test_empty_table(spark, table):
    pages = table([], "page_id long, url string, html string", "pages", 1)
    assert warc.resolved(warc.archive_pages(pages)).count() == 0


def test_dates_and_headers():
    assert warc.warc_date("1998") == "1998-01-01T00:00:00Z"
    assert warc.warc_date("19980203040506") == "1998-02-03T04:05:06Z"
    assert warc.synthetic_id("a", 1) == warc.synthetic_id("a", 1) != warc.synthetic_id("a", 2)


def test_archives_are_packed_fast_and_read_once(spark, table, tmp_path):
    pages = table([(i, f"http://h/{i}", " ".join(hashlib.md5(b"%d" % (i * k % 997)).hexdigest()[:5] for k in range(400))) for i in range(200)], "page_id long, url string, html string", "pages", 1)
    records = warc.archive_pages(pages, str(tmp_path / "kept"))
    for kind in ("arc", "warc"):
        for file in (tmp_path / "kept" / kind).glob("*.gz"):
            whole = gzip.decompress(packed := file.read_bytes())
            own, default = (len(zlib.compress(whole, level, 31)) for level in (4, 6))
            assert abs(len(packed) - own) < abs(len(packed) - default)
    found = warc.resolved(records)
    assert found.inputFiles() and not any("/kept/" in f for f in found.inputFiles()) and found.count() == 200
