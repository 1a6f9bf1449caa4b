"""Archives: round trip, framing, and revisits against a plain loop."""

import gzip
import random

import pytest

from marlstone.llm import warc
from marlstone.session import new_path


def resolve(pages, least=0):
    best = {}
    for i, (page, _, html) in enumerate(pages):
        body = (html or "").encode()
        if len(body) >= least:
            best[body] = max(best.get(body, (-1, -1)), (page if page is not None else -1, i))
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        out.append((page, len(body), warc.digest_of(body), best.get(body, (None,))[0]))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_revisits(spark, least):
    rng = random.Random(least)
    bodies = [None, "", "a", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "same " * 30, "x" * 300_000, "line\n\n"]
    pages = [(i, f"http://e.org/{i}\r\nX: y", rng.choice(bodies)) for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    raw = warc.read_archives(warc.write_archives(frame, new_path(spark, "t")))
    got = {r.page_id: r for r in warc.resolved(warc.read_archives(warc.deduplicate(raw, new_path(spark, "t"), least))).collect()}
    for page, size, digest, owner in resolve(pages, least):
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (size, digest)
        expected = ("response", None) if owner is None or owner == page else ("revisit", owner)
        assert (r.record_type, r.refers_to) == expected


def test_null_and_repeated_keys(spark):
    pages = [(None, None, "same"), (7, None, "same"), (7, None, "same"), (None, "u", "other"), (None, "u", "other")]
    raw = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), new_path(spark, "t")))
    rows = warc.resolved(warc.read_archives(warc.deduplicate(raw, new_path(spark, "t")))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "response", 0), (0, "revisit", 0), (0, "revisit", 7), (7, "response", 0), (7, "revisit", 7)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, new_path(spark, "t"))).count() == 0


def test_members_are_whole_records(tmp_path):
    path = tmp_path / "a.warc.gz"
    members = [warc._member({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, bytes([i]) * i * 1000) for i in range(5)]
    path.write_bytes(b"".join(members))
    system, own = warc._system(str(path))
    found = list(warc._members(system, own))
    assert [(o, n) for o, n, _ in found] == [(sum(map(len, members[:i])), len(m)) for i, m in enumerate(members)]
    assert [warc._parsed(d).payload for _, _, d in found] == [bytes([i]) * i * 1000 for i in range(5)]
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == 5
    path.write_bytes(b"".join(members)[:-3])
    with pytest.raises(EOFError):
        list(warc._members(system, own))


def test_clashing_columns_and_long_uris(spark):
    rows = [(1, "http://e.org/" + "x" * 200_000, "body", 5, "p", "d"), (2, "http://e.org/é ü", "body", 6, "q", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int, path string, payload_digest string")
    raw = warc.read_archives(warc.write_archives(pages, new_path(spark, "t")))
    assert {r.page_id: len(r.uri) for r in raw.collect()} == {1: 200_013, 2: len("http://e.org/%C3%A9%20%C3%BC")}
    rows = warc.resolved(warc.read_archives(warc.deduplicate(raw, new_path(spark, "t")))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [(1, "revisit", 2), (2, "response", None)]


def test_many_revisits_of_one_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 2000)
    pages = spark.range(900).selectExpr("id as page_id", "cast(null as string) as url", "if(id % 3 = 0, 'hot', concat('b', id)) as html").repartition(4)
    rows = warc.resolved(warc.read_archives(warc.deduplicate(warc.read_archives(warc.write_archives(pages, new_path(spark, "t"))), new_path(spark, "t")))).collect()
    assert len(rows) == 900 and sum(r.record_type == "revisit" for r in rows) == 299 and {r.refers_to for r in rows} == {None, 897}
