import base64
import hashlib
import random

import pytest

from loomline.llm import queries, warc
from tests.llm.cases import LONG


def record(k: int, body: bytes) -> bytes:
    digest = warc.sha1_base32(body)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def found(data: bytes):
    return [(x.gap, x.start, x.end, x.headers.get("warc-record-id")) for x in warc.salvage(data)]


def test_plain_and_gzip_records_pass():
    bodies = [b"", b"x" * 1000, b"WARC/1.1\r\n inside \r\n\r\n", b"\x1f\x8b\x08 inside"]
    for wrap in (bytes, warc.member):
        parts = [wrap(record(k, b)) for k, b in enumerate(bodies)]
        out = list(warc.salvage(b"".join(parts)))
        assert [x.payload for x in out] == bodies and not any(x.gap for x in out)
        assert [x.end - x.start for x in out] == [len(p) for p in parts]


def test_later_records_survive_damage_and_gaps_are_logged():
    for wrap in (bytes, warc.member):
        parts = [wrap(record(k, bytes([65 + k]) * 200)) for k in range(5)]
        starts = [sum(map(len, parts[:k])) for k in range(6)]
        whole = b"".join(parts)
        for at in (starts[2] + 3, starts[2] + len(parts[2]) // 2, starts[3] - 5):
            broken = bytearray(whole)
            broken[at] ^= 0xFF
            out = found(bytes(broken))
            if wrap is warc.member and at == starts[3] - 5:  # only the member's checksum: the record's own digest holds
                assert [o[3] for o in out if o[0] is None] == [f"<urn:page:{k}>" for k in range(5)]
                ((begin, end),) = [(o[1], o[2]) for o in out if o[0]]
                assert at - 4 <= begin <= at and end == starts[3]
                continue
            assert [o[3] for o in out if o[0] is None] == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]
            assert [(o[1], o[2]) for o in out if o[0]] == [(starts[2], starts[3])]
        # bytes lost, bytes put in, the file cut short
        out = found(whole[: starts[1] + 7] + whole[starts[1] + 40 :])
        assert [o[3] for o in out if o[0] is None] == [f"<urn:page:{k}>" for k in (0, 2, 3, 4)]
        out = found(parts[0] + b"junk WARC/1.1\r\njunk" + b"".join(parts[1:]))
        assert len([o for o in out if o[0] is None]) == 5 and [(o[1], o[2]) for o in out if o[0]] == [(starts[1], starts[1] + 19)]
        for lost, left in ((9, 4), (60, 4)) if wrap is bytes else ((9, 5), (60, 4)):  # nine bytes of a member are its checksum and an empty end
            out = found(whole[:-lost])
            assert len([o for o in out if o[0] is None]) == left and out[-1][0] and out[-1][2] == len(whole) - lost


def noise(n: int, seed: int) -> bytes:
    return random.Random(seed).randbytes(n)


def test_what_a_damaged_member_held_before_the_damage():
    """Fifty records in one member, a byte of it flipped or the file cut: those before come out, the rest is a gap from the place of the damage."""
    parts = [record(k, noise(300, k)) for k in range(50)]
    starts = [sum(map(len, parts[:k])) for k in range(51)]
    whole = warc.member(b"".join(parts))
    after = record(99, b"after")
    for at in (len(whole) // 2, len(whole) * 9 // 10, len(whole) - 3):
        broken = bytearray(whole + after)
        broken[at] ^= 0x55
        out = list(warc.salvage(bytes(broken)))
        good = [x for x in out if x.gap is None]
        kept = [int(x.headers["warc-record-id"][10:-1]) for x in good[:-1]]  # after the damage, too, where the stream could be read on
        before = 50 * at // len(whole) - 3
        assert kept[:before] == list(range(before)) and kept == sorted(set(kept))
        assert good[-1].payload == b"after" and good[-1].start == len(whole)
        assert [x.inner for x in good[:-1]] == [(starts[k], starts[k + 1]) for k in kept]
        rest = [x for x in out if x.gap and x.inner is None]
        assert [(x.gap, x.end) for x in rest] == [("corrupt member", len(whole))] and at - 40 <= rest[0].start <= len(whole)
    cut = list(warc.salvage(whole[: len(whole) * 9 // 10]))
    assert 42 <= sum(x.gap is None for x in cut) <= 46 and all(x.end == len(whole) * 9 // 10 for x in cut)


def test_gaps_inside_a_member_have_their_own_place():
    parts = [record(0, b"first"), record(1, b"second").replace(b"second", b"2econd"), record(2, b"third")]
    out = list(warc.salvage(record(9, b"x") + warc.member(b"".join(parts))))
    inner = [(x.gap, x.inner) for x in out[1:]]
    a, b = len(parts[0]), len(parts[0] + parts[1])
    assert inner == [(None, (0, a)), ("in member: block digest differs", (a, b)), (None, (b, b + len(parts[2])))] and len({(x.start, x.end) for x in out[1:]}) == 1


def test_absurd_lengths_are_gaps(spark, tmp_path):
    bad = [record(0, b"a").replace(b"Content-Length: 1", b"Content-Length: " + n) for n in (b"9" * 5000, b"-1", b"1e3", "\u0661".encode(), b"", b"9" * 18)]
    stated = record(1, b"ab").replace(b"Content-Length", b"X-Full-Payload-Length: " + b"9" * 5000 + b"\r\nX-Other: \xff\r\nContent-Length")
    (tmp_path / "a.warc").write_bytes(b"".join(bad) + stated + warc.member(stated))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.full_length, r.inner_start) for r in rows if r.gap is None] == [("<urn:page:1>", 2, None), ("<urn:page:1>", 2, 0)]
    assert sum(r.length for r in rows if r.gap) == sum(map(len, bad))


def test_members_are_inflated_within_a_bound(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    bomb = warc.member(record(0, b"a") + b"\x00" * (200 << 20))
    out = found(bomb + record(1, b"b"))
    assert [o[3] for o in out if o[0] is None] == ["<urn:page:0>", "<urn:page:1>"] and "member too large" in {o[0] for o in out}


def test_two_thousand_random_damages():
    pick = random.Random(4)
    bodies = [noise(pick.randint(0, 120), k) if k % 2 else b"text " * pick.randint(0, 40) for k in range(12)]
    forms = [b"".join(record(k, b) for k, b in enumerate(bodies)), b"".join(warc.member(record(k, b)) for k, b in enumerate(bodies)), warc.member(b"".join(record(k, b) for k, b in enumerate(bodies)))]
    for _ in range(2000):
        data = bytearray(pick.choice(forms))
        for _ in range(pick.randint(1, 4)):
            at = pick.randrange(len(data))
            what = pick.randrange(4)
            if what == 0:
                data[at] = pick.randrange(256)
            elif what == 1:
                del data[at : at + pick.randint(1, 60)]
            elif what == 2:
                data[at:at] = noise(pick.randint(1, 30), at)
            else:
                data[at:at] = pick.choice([b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\r\n\r\n", b"Content-Length: 99999999999999999999\r\n"])
            data = data or bytearray(b"x")
        end = 0
        for x in warc.salvage(bytes(data)):  # what is found covers the file in order
            if x.inner is None or x.start >= end:
                assert x.start == end
                end = x.end
            if x.gap is None:
                assert x.payload in bodies or "warc-block-digest" not in x.headers
        assert end == len(data)


def test_stated_lengths_that_lie():
    data = record(0, b"first") + record(1, b"second").replace(b"Content-Length: 6", b"Content-Length: 9999999") + record(2, b"third")
    assert [o[3] for o in found(data) if o[0] is None] == ["<urn:page:0>", "<urn:page:2>"]
    assert found(b"") == [] and found(b"nothing here")[0][:3] == ("no version line", 0, 12)


def test_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ c\r\nX: y", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (6, "u", "\r\n\r\nWARC/1.1\r\n é🙂\x00"), (7, "u", LONG), (8, "u", "once"), (2, "http://b/", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    out = {}
    for r in warc.archive_round_trip(pages).collect():
        assert r.gap is None
        out.setdefault((r.record_id, r.record_type), []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    assert {k: v[0].refers_to for k, v in out.items() if k[1] == "revisit"} == {("<urn:page:1>", "revisit"): "<urn:page:2>", ("<urn:page:none>", "revisit"): "<urn:page:2>", ("<urn:page:3>", "revisit"): "<urn:page:4>"}
    assert len(out["<urn:page:2>", "response"]) == 2
    for page_id, _, html in rows:
        body = (html or "").encode()
        kinds = [v for k, v in out.items() if k[0] == f"<urn:page:{'none' if page_id is None else page_id}>"]
        got = kinds[0][0]
        assert got.full_length == len(body) and got.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert got.record_type == "revisit" or bytes(got.payload) == body


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r.record_id: r.record_type for r in warc.archive_round_trip(pages, revisit_from_bytes=3).collect()}
    assert kinds == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "revisit", "<urn:page:4>": "response"}


def test_many_copies_take_the_shuffled_way(spark, tmp_path):
    pages = spark.range(300).selectExpr("id page_id", "'u' url", "cast(id % 100 as string) html")
    warc.write_archives(pages, str(tmp_path / "w"), broadcast_rows=10)
    kinds = [r.record_type for r in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    assert kinds.count("response") == 100 and kinds.count("revisit") == 200


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_headers_of_any_length(spark, tmp_path):
    long = "http://a/" + "x" * 300_000
    rows = [(1, long, "same"), (2, "http://b/" + " é" * 40_000, "same"), (3, "u", "after"), (4, long + "\r\n\r\n", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.record_id: r for r in warc.archive_round_trip(pages).collect()}
    assert not any(r.gap for r in out.values())
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {"<urn:page:1>": ("revisit", "<urn:page:2>"), "<urn:page:2>": ("response", None), "<urn:page:3>": ("response", None), "<urn:page:4>": ("response", None)}
    assert [out[f"<urn:page:{k}>"].target_uri for k in (1, 2, 4)] == [long, "http://b/" + "%20é" * 40_000, long + "%0D%0A%0D%0A"]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.page_id, r.refers_to) for r in queries.op1_warc(spark, str(tmp_path)).collect()} == {(1, 2), (2, None), (3, None), (4, None)}


def test_a_gap_in_own_archives_raises(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (tmp_path / "broken").write_bytes(record(1, b"a") + record(2, b"b")[:-9])
    monkeypatch.setattr(warc, "archive_round_trip", lambda pages: warc.read_archives(pages.sparkSession, str(tmp_path / "broken")))
    with pytest.raises(Exception, match="a gap in an archive just written"):
        queries.op1_warc(spark, str(tmp_path)).collect()


def _one(block=b"abc", kind="resource", **headers):
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in {"WARC_Type": kind, "WARC_Record_ID": "<urn:x>", **headers, "Content_Length": len(block)}.items()]
    return ("\r\n".join(["WARC/1.0", *lines]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_digests_go_by_their_algorithm():
    import hashlib

    sha = hashlib.sha1(b"abc").digest()
    b32 = base64.b32encode(sha).decode()
    good = [f"sha1:{b32}", f"sha1:{b32.lower()}", f"SHA-1:{sha.hex()}", f"sha256:{hashlib.sha256(b'abc').hexdigest()}", f"md5:{hashlib.md5(b'abc').hexdigest()}", f"md5:{base64.b32encode(hashlib.md5(b'abc').digest()).decode()}", "whirlpool3:zzz"]
    bad = [f"sha1:{b32[:-1]}A", "sha256:00", "md5:", "nothing"]
    for name in ("WARC_Block_Digest", "WARC_Payload_Digest"):
        assert all([x.gap for x in warc.salvage(_one(**{name: d}))] == [None] for d in good)
        assert all([x.gap for x in warc.salvage(_one(**{name: d}))] == [f"{name.split('_')[1].lower()} digest differs"] for d in bad)
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nabc"
    http = {"Content_Type": "application/http; msgtype=response"}
    assert [x.gap for x in warc.salvage(_one(page, "response", WARC_Payload_Digest=good[0], **http))] == [None]
    assert [x.gap for x in warc.salvage(_one(page + b"d", "response", WARC_Payload_Digest=good[0], **http))] == ["payload digest differs"]
    chunked = page.replace(b"Content-Type: text/html", b"Transfer-Encoding: chunked")
    assert [x.gap for x in warc.salvage(_one(chunked + b"d", "response", WARC_Payload_Digest=good[0], **http))] == [None]
    assert [x.gap for x in warc.salvage(_one(b"", "revisit", WARC_Payload_Digest=good[0]))] == [None]


def test_folded_headers():
    record = _one(WARC_Target_URI="http://a/\r\n b\r\n\tc")
    (found,) = warc.salvage(record + b"")
    assert found.gap is None and found.headers["warc-target-uri"] == "http://a/ b c" and found.payload == b"abc"
    broken = record.replace(b"WARC/1.0\r\n", b"WARC/1.0\r\n folded from nothing\r\n")
    assert [x.gap for x in warc.salvage(broken)] == ["malformed header"]
