"""Transaction assembly against union-find over the same records, and exact round trips of pages and files."""

import gzip
import random

import pytest

from ferrule.llm import warc as W


def row(rid, to=(), kind="response", uri="http://a/", body=b"x"):
    return (rid, list(to), kind, uri, "2024", "text/html", [("A", "b")], body)


def frame(spark, rows, group=1):
    """Records, the root of each taken among group neighbours."""
    rooted = [r for a in range(0, len(rows), group) for r in W.rooted([(x[0], x[1] or [], *x[2:]) for x in rows[a : a + group]])]
    return spark.createDataFrame(rooted, W.RECORDS)


def brute(rows):
    """Sets of record positions that are linked."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    keys = [r[0] or (r[1][0] if r[1] else ("alone", i)) for i, r in enumerate(rows)]
    for k, r in zip(keys, rows):
        find(k)
        for to in r[1]:
            a, b = find(k), find(to)
            root[a] = b
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(k), []).append(i)
    return groups.values()


def expected(rows):
    out = []
    for g in brute(rows):
        of = {n: sorted({(r[0], r[2], r[3], r[4], r[5], tuple(r[6]), r[7]) for r in (rows[i] for i in g) if W.GROUPS.get(r[2], "others") == n}, key=str) for n in [*W.GROUPS.values(), "others"]}
        ids = [rows[i][0] or (rows[i][1][0] if rows[i][1] else None) for i in g]
        answers = [x for i, x in zip(g, ids) if rows[i][2] == "response"]
        out.append((min(answers or ids, key=str), of))
    return sorted(out, key=str)


def got(df):
    flat = lambda rs: sorted(((r.record_id, r.type, r.target_uri, r.date, r.content_type, tuple(map(tuple, r.headers)), bytes(r.payload)) for r in rs), key=str)
    return sorted(((r.capture_id, {n: flat(r[n]) for n in [*W.GROUPS.values(), "others"]}) for r in df.collect()), key=str)


def test_assembly_against_union_find(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        kind = rnd.choice(["request", "response", "metadata", "warcinfo"])
        to = [f"id{rnd.randrange(200):03d}" for _ in range(rnd.choice([0, 0, 1, 1, 2]))]
        rows.append(row(f"id{i:03d}", to, kind, body=str(i).encode()))
    rows += [rows[3], rows[3], row(None, ["id001"], "metadata"), row("lost1", ["gone"], "request"), row("lost2", ["gone"], "metadata")]
    want = expected(rows)
    for group in (1, 7, 1000):
        assert got(W.assemble(frame(spark, rows, group))) == want
    assert got(W.assemble(frame(spark, rows).drop("root"))) == want


def test_many_moved_records_are_shuffled(spark, monkeypatch):
    rows = [row("a"), row("b", ["a"]), row("q", ["b"], "request"), row("z", ["y"], "metadata"), row("y", [], "request"), row("lost", ["gone"], "metadata"), row("a", [], "request")]
    want = expected(rows)
    assert got(W.assemble(frame(spark, rows))) == want
    monkeypatch.setattr(W, "small", lambda df: df.hint("merge"))
    assert got(W.assemble(frame(spark, rows))) == want and len(want) == 3


def test_edges(spark):
    rows = [row(None), row(None), (None, None, None, None, None, None, None, None), ("x", None, None, None, None, None, None, None), ("y", ["y"], "response", "u", None, None, [], b"\0" * 3_000_000)]
    out = W.assemble(frame(spark, rows)).collect()
    assert sorted((r.capture_id or "-", len(r.responses), len(r.others)) for r in out) == [("-", 0, 1), ("-", 1, 0), ("-", 1, 0), ("x", 0, 1), ("y", 1, 0)]
    assert W.assemble(frame(spark, rows).where("false")).count() == 0
    more = frame(spark, rows[-1:]).selectExpr("*", "1 AS capture_id", "2 AS kind", "3 AS single", "4 AS r", "5 AS __id")
    assert W.assemble(more).count() == 1


def test_pages_round_trip(spark):
    pages = [(1, "http://h/p?q#f", "<p>é</p>\r\n\r\nWARC/1.1"), (2, None, None), (None, "https://x.example/", ""), (1, "http://h/p?q#f", "<p>é</p>\r\n\r\nWARC/1.1"), (5, "http://long/", "y" * 2_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = W.assemble(W.warc_records(W.pages_as_warc(df))).collect()
    assert len(out) == 4
    for r in out:
        assert (len(r.requests), len(r.responses), len(r.metadata), len(r.others)) == (1, 1, 1, 0)
        said = bytes(r.metadata[0].payload).decode().split(": ")[1].strip()
        page = next(p for p in pages if (str(p[0]) if p[0] else "") == said)
        assert bytes(r.responses[0].payload).decode().partition("\r\n\r\n")[2] == (page[2] or "")
        assert r.target_uri == page[1] and r.capture_id == r.responses[0].record_id
    assert W.assemble(W.warc_records(W.pages_as_warc(df.where("false")))).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "z" * i * 100) for i in range(20)], "page_id long, url string, html string")
    blocks = [bytes(r.warc) for r in W.pages_as_warc(df).collect()]
    (tmp_path / "a b.warc").write_bytes(b"".join(blocks[:7]))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks[7:])))
    want = sorted((r.record_id, bytes(r.payload)) for r in W.warc_records(W.pages_as_warc(df)).collect())
    assert sorted((r.record_id, bytes(r.payload)) for r in W.read_warc(spark, str(tmp_path)).collect()) == want and len(want) == 60
    assert len(list(W.parse(b"".join(map(gzip.compress, blocks))))) == 60
    files = lambda payloads: W.read_warc(spark, f"file://{tmp_path}", payloads)
    assert files(False).where("payload IS NOT NULL").count() == 0
    assert got(W.assemble(files(True), files(False))) == got(W.assemble(W.warc_records(W.pages_as_warc(df))))


@pytest.mark.parametrize("data", [b"junk", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", b"WARC/1.1\r\nX: y\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1"])
def test_damage_is_an_error(data):
    with pytest.raises(W.BadRecord):
        list(W.parse(data))


def test_folded_headers():
    (r,) = W.parse(b"WARC/1.0\r\nWARC-Type: Response\r\nX-Long: a\r\n  b\r\nWARC-Concurrent-To: <i>\r\nWARC-Concurrent-To: <j>\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert r[1] == ["<i>", "<j>"] and r[2] == "response" and ("X-Long", "a b") in r[6]
