import base64
import gzip
import hashlib
import random
import zlib

import pytest
from llm_cases import prose, rows_of

from clickloom.llm import warc


def pages():
    r = random.Random(2)
    rows = [(i, f"http://h/{i}", f"<p>{prose(i, r.randrange(200))}</p>") for i in range(40)]
    rows += [(100 + i, "http://h/same", "<b>copy é</b>") for i in range(30)] + [(200, None, None), (201, "http://a b\r\nX: y", ""), (202, "u", "")]
    return rows + [(None, "u", "<b>copy é</b>"), (300, "u", "twice"), (300, "u", "twice"), (301, "u", "twice")]


def want(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = i is not None and i != first[html or ""] and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((None if i is None else str(i), len(data), digest, "revisit" if revisit else "response", str(first[html or ""]) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, tmp_path, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr("*", "1 as kind", "2 as _text")
    warc.write_archives(frame, str(tmp_path / "w"), min_bytes=least)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert rows_of(got, "page", "payload_bytes", "payload_digest", "kind", "refers_to") == want(pages(), least)
    texts = {r.page: bytes(r.payload) for r in got.where("kind = 'response'").collect()}
    assert texts["3"].decode() == pages()[3][2] and texts["200"] == b""
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    assert len(files) > 3 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1") for f in files)


def test_long_addresses_and_odd_line_ends_come_back(spark, tmp_path):
    urls = ["http://h/" + "x" * 100_000, "http://h/\u2028a\u2029b\x85c", "http://h/end\u2028", "http://h/é" * 20_000]
    frame = spark.createDataFrame([(i, url, f"<p>{i}</p>") for i, url in enumerate(urls)], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    assert rows_of(warc.read_archives(spark, str(tmp_path / "w")), "kind", "page", "url") == [("response", str(i), url) for i, url in enumerate(urls)]


def test_long_http_headers():
    block = b"HTTP/1.1 200 OK\r\nX-Long: " + b"x" * 100_000 + b"\r\n\r\nbody"
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Payload-Digest: sha1:{warc.sha1_base32(b'body')}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode()
    (a, b, got), = warc.salvage(head + block + warc.END)
    assert got["payload"] == b"body"


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def record(i, size=50):
    payload = (prose(i, size)).encode()
    return warc.record("response", str(i), "http://u", warc.sha1_base32(payload), len(payload), payload, None, "1970-01-01T00:00:00Z")


def member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def summary(data):
    """Records by number, and gaps."""
    out = []
    for a, b, got in warc.salvage(data):
        out.append((a, b, got if isinstance(got, str) else int(got["fields"]["warc-record-id"][10:-1])))
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_every_damaged_record_costs_itself_only(packed):
    parts = [member(record(i)) if packed else record(i) for i in range(6)]
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    assert summary(whole) == [(starts[i], starts[i + 1], i) for i in range(6)]
    r = random.Random(1)
    for _ in range(120):
        k = r.randrange(6)
        at = r.randrange(starts[k], starts[k + 1])
        hurt = bytearray(whole)
        hurt[at] ^= 1 << r.randrange(8)
        found = list(warc.salvage(bytes(hurt)))
        kept = [a for a, _, x in found if not isinstance(x, str)]
        # A flipped bit in a header field that no digest covers may leave the record valid.
        assert [a for a in starts[:6] if a != starts[k]] == [a for a in kept if a != starts[k]]
        gaps = [(a, b) for a, b, x in found if isinstance(x, str)]
        assert starts[k] in kept or gaps == [(starts[k], starts[k + 1])]


def test_cut_inserted_and_foreign_bytes():
    a, b, c = (member(record(i)) for i in range(3))
    assert [x for *_, x in summary(a + b[: len(b) // 2] + c)] == [0, "gzip member", 2]
    assert summary(b"junk" + a)[0] == (0, 4, "version line")
    assert [x for *_, x in summary(a + b"\0\0\0" + c + b"\0\0")] == [0, 2]
    assert [x for *_, x in summary(a + c[:20])] == [0, "gzip member"]
    plain = record(1)
    assert [x for *_, x in summary(plain[:-30] + record(2))] == ["record end", 2]
    assert [x for *_, x in summary(member(b"no record") + a)] == ["member content", 0]
    assert [x for *_, x in summary(member(record(4) + record(5)) + plain)] == [4, 5, 1]
    wrong = record(3).replace(b"Content-Length: ", b"Content-Length: x", 1)
    assert summary(b"") == [] and [x for *_, x in summary(wrong + plain)][-1] == 1


def test_damaged_members_give_the_records_before_the_damage():
    r = random.Random(3)
    parts = [record(i, 3000) for i in range(6)]
    whole, after = member(b"".join(parts)), member(record(9))
    half = summary(whole[: len(whole) // 2])
    kept = [x for *_, x in half if isinstance(x, int)]
    assert kept == list(range(len(kept))) and len(kept) >= 2 and half[-1][1] == len(whole) // 2
    for _ in range(40):
        at = r.randrange(len(whole) // 2, len(whole) - 8)
        hurt = whole[:at] + bytes(x ^ 255 for x in whole[at : at + 4]) + whole[at + 4 :]
        got = summary(hurt + after)
        kept = [x for *_, x in got if isinstance(x, int)]
        assert kept[:2] == [0, 1] and kept[-1] == 9 and any(isinstance(x, str) for *_, x in got)
    # Only the checksum is wrong: any record's header may be damaged.
    assert [x for *_, x in summary(whole[:-8] + b"oops" + whole[-4:] + after)] == ["gzip member", 9]


def test_gaps_inside_members_have_their_place(spark, tmp_path):
    first, bad, last = record(0), record(1)[:-9], record(2)
    (tmp_path / "a.warc.gz").write_bytes(member(first + bad + last))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(x.page, x.inside_offset, x.inside_length) for x in rows] == [("0", None, None), (None, len(first), len(bad)), ("2", None, None)]


def test_gaps_are_rows(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(member(record(0)) + b"\x1f\x8b\x08oops" + member(record(1)))
    (tmp_path / "b.warc").write_bytes(record(2) + record(3)[:-9])
    got = rows_of(warc.read_archives(spark, str(tmp_path)), "kind", "page", "reason")
    assert got == sorted([("response", "0", None), ("response", "1", None), ("response", "2", None), ("gap", None, "gzip member"), ("gap", None, "record end")], key=repr)
