"""Media files by exact round trips, URL verdicts against plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from corpusflow.llm import matroska as mk
from corpusflow.llm import urls


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 256, 2048, 2049, 5000, 41_000, 200_000])
def test_files_hold_their_samples(n):
    text = ("Straße é " * (n // 9 + 1))[:n]
    raw, payload = mk.payload_of(text)
    data = mk.write(payload)
    m = mk.read(data)
    assert m.error is None and mk.samples(data, m) == payload and len(payload) % 64 == 0 and payload[:raw] == text.encode()
    assert m.tracks[0]["codec"] == "A_PCM/INT/LIT" and m.tracks[0]["bits"] == 8 and m.tracks[0]["rate"] == mk.RATE
    times = [p[1] for p in m.packets]
    assert times == [i * 32_000_000 for i in range(len(times))]
    assert {p[5] for p in m.packets} == {c[2] for c in m.cues}  # every cluster has a cue that points at it


def block(flags: int, body: bytes, time: int = 5) -> bytes:
    return b"\x81" + time.to_bytes(2, "big") + bytes([flags]) + body


def test_lacing_groups_and_unknown_sizes():
    xiph = block(0x02, bytes([2, 255, 1, 3]) + b"a" * 256 + b"b" * 3 + b"c" * 7)
    ebml = block(0x06, bytes([2, 0x84]) + bytes([0x80 | (2 + 63)]) + b"d" * 4 + b"e" * 6 + b"f" * 5)
    fixed = block(0x04, bytes([1]) + b"gghh")
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, fixed) + mk.element(mk.REFERENCE, b"\xff"))
    plain = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block(0, b"i")))
    unknown = b"\x01" + b"\xff" * 7
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK, mk.uint(mk.TRACK_NUMBER, 1) + mk.uint(mk.TRACK_TYPE, 1) + mk.element(mk.CODEC, b"V_TEST")))
    one = mk._id(mk.CLUSTER) + unknown + mk.uint(mk.TIMESTAMP, 100) + mk.element(mk.SIMPLE_BLOCK, xiph) + mk.element(mk.SIMPLE_BLOCK, ebml)
    two = mk._id(mk.CLUSTER) + unknown + mk.uint(mk.TIMESTAMP, 200) + group + plain
    data = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"webm")) + mk._id(mk.SEGMENT) + unknown + mk.element(0xEC, b"\0" * 9) + tracks + one + two
    m = mk.read(data)
    assert m.error is None and m.doc_type == "webm"
    assert [data[s:s + n] for _, _, s, n, _, _ in m.packets] == [b"a" * 256, b"b" * 3, b"c" * 7, b"d" * 4, b"e" * 6, b"f" * 5, b"gg", b"hh", b"i"]
    assert [p[1] // 1_000_000 for p in m.packets] == [105] * 6 + [205] * 3
    assert [p[4] for p in m.packets[-3:]] == [False, False, True]
    assert len({p[5] for p in m.packets}) == 2


def test_broken_files():
    data = mk.write(mk.payload_of("word " * 3000)[1])
    whole = mk.read(data)
    for cut in range(0, len(data), 977):
        m = mk.read(data[:cut])
        assert m.error and len(m.packets) <= len(whole.packets)
    assert mk.read(b"").error and mk.read(b"\x00" * 50).error and mk.read(b"plain text").error


def test_hostile_files(spark):
    """Deep nesting and numbers beyond 64 bits are errors of the file, not of the job."""
    deep = b""
    for _ in range(3000):
        deep = mk.element(mk.BLOCK_GROUP, deep)
    good = mk.write(mk.payload_of("x" * 5000)[1])
    head = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"matroska"))
    long_time = head + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk.element(mk.TIMESTAMP, b"\xff" * 9) + mk.element(mk.SIMPLE_BLOCK, b"\x81\0\0\x80abc")))
    big_time = head + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk.element(mk.TIMESTAMP, b"\x7f" * 8) + mk.element(mk.SIMPLE_BLOCK, b"\x81\0\0\x80abc")))
    files = [head + mk.element(mk.SEGMENT, deep), long_time, big_time, good]
    df = spark.createDataFrame(list(enumerate(map(bytearray, files))), "i int, m binary")
    errors = {r.i: r.error for r in mk.packets(df, "i", "m").collect() if r.error}
    assert errors == {0: "elements nested too deep", 1: "number beyond 64 bits", 2: "number beyond 64 bits"}
    assert mk.packets(df, "i", "m").where("i = 3 and error is null").count() == len(mk.read(good).packets)


def test_tables(spark, odd, empty):
    got = mk.stored_media(odd, "doc_id", "text").collect()
    assert len(got) == odd.count()
    want = Counter()
    for r in odd.collect():
        n, p = mk.payload_of(r.text)
        data = mk.write(p)
        want[r.doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest()] += 1
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert mk.stored_media(empty, "doc_id", "text").count() == 0
    media = spark.createDataFrame([(1, bytearray(mk.write(b"x" * 64))), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    rows = mk.packets(media, "id", "media").orderBy("id").collect()
    assert [(r.id, r.length, r.error is None) for r in rows] == [(1, 64, True), (3, None, False)]


URLS = ["http://A.example.NET/en/5?x", "https://example.net/de/7#t", "http://x.example.com/de/1", "http://example.com", "ftp://w.org/fr/9", "no url", "", None, "a://b://c/d?e#f",
        "http://bad.example.org/en/3", "http://bad.example.org/en/4.html", "http://bad.example.org/en/11/", "http://notnet/en/", "http://net/x", "http://good.example.org/en/12", "//x"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame([], "document long, bad int"), "page_id", "url").collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
        host = rest[:cut].lower()
        assert (got[i].host, got[i].path) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i].rule == (max(fits)[1] if fits else None)
        assert got[i].verdict == (max(fits)[2] if fits else "allow")
    assert urls.judge(pages.where("false"), spark.createDataFrame([], "document long, bad int"), "page_id", "url").count() == 0


def test_reputation_blocks_bad_hosts_and_shrinks_thin_ones(spark):
    hosts = [("bad.example.org", 0, 60), ("thin.example.org", 500, 501), *((f"h{i}.example.org", 1000 + 40 * i, 1040 + 40 * i) for i in range(20))]
    pages = spark.createDataFrame([(i, f"http://{h}/en/{d}", "x") for h, lo, hi in hosts for i, d in enumerate(range(lo, hi))], "page_id long, url string, host string")
    bad = {*range(60), 500, *(d for d in range(1000, 1800) if d % 5 == 0)}
    outcomes = spark.createDataFrame([(d, int(d in bad)) for d in range(1800)] + [(5, None), (None, 1)], "document long, bad int")
    got = urls.judge(pages, outcomes, "page_id", "url").groupBy("host").agg({"verdict": "max", "bad_share": "max"}).collect()
    by = {r["host"]: r for r in got}
    assert by["bad.example.org"]["max(verdict)"] == "block" and by["h3.example.org"]["max(verdict)"] == "allow"
    assert by["thin.example.org"]["max(verdict)"] == "allow" and by["thin.example.org"]["max(bad_share)"] < 0.9  # one bad page isn't enough
