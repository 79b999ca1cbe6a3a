"""Queries against brute force over whole tables, and over pages that the tables lack."""

import json
import os
import re

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ferrule.functions import extract, rules, text, urls
from ferrule.operators import secrets
from ferrule.plans import audit, web

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()


@pytest.fixture
def pages(spark, tmp_path):
    """A folder with a table of pages of the given texts."""

    def write(*htmls):
        rows = [(k, f"https://www.example.com/{k}", h) for k, h in enumerate(htmls)]
        spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
        return str(tmp_path)

    return write


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holding(links, admitted):
    """Each literal with the shortest admitted path in it, the first of equals."""
    best = {x: min((p for p in admitted if p in x), key=lambda p: (len(p), p), default=None) for x in links}
    return {(x, p) for x, p in best.items() if p is not None}


def test_literal_contains_long_paths(spark, pages):
    at = pages("""f("/api/user/list"); g("/v2/api/user/list"); h("/orders/recent/items"); i("/a/b/c"); j("/v1.0/api/user/list")""")
    got = {(r.literal, r.api_path) for r in QUERIES["literal_contains_path"](spark, at).collect()}
    long = "/api/user/list"
    assert got == {(long, long), ("/v2" + long, long), ("/v1.0" + long, long), ("/orders/recent/items", "/orders/recent/items"), ("/a/b/c", "/a/b/c")}


def test_literal_contains_path_of_whole_table(spark):
    found = table(spark, SF, "pages").select(extract.links(F.col("html")).alias("x")).collect()
    links = {x for r in found for x in r.x}
    one = spark.createDataFrame([(x,) for x in links], "link string")
    admitted = {r.link for r in one.where(extract.is_api_path(F.col("link"))).collect()}
    got = [(r.literal, r.api_path) for r in QUERIES["literal_contains_path"](spark, SF).collect()]
    assert set(got) == holding(links, admitted) and len(got) == len(set(got)) and any(len(p) >= 9 for _, p in got)


def test_pre_unwrap_takes_pages_with_pre(spark, pages):
    at = pages("<html><pre>a</pre> x <PRE class=k>b\nc</PRE></html>", "<p>none</p>", "x <pre>y</pre>", "  <html><body><pre></pre></body>")
    got = {r.id: r.body for r in QUERIES["pre_unwrap"](spark, at).where("id >= 100").collect()}
    assert got == {100: "a\nb\nc", 101: "<p>none</p>", 102: "x <pre>y</pre>", 103: ""}


def test_literals_of_long_texts_and_long_literals(spark):
    token, short = "".join("aB3-xY9_"[k * k % 8] for k in range(700)), "aB3-xY9_qq"
    rows = [(1, f"api_key = '{token}'"), (2, "x\n" * 600_000 + f"k = '{short}'"), (3, "'" + "z" * 1_000_001), (4, f"token = '{short}', '{token}'" + ", 'word00'" * 200_000)]
    got = {(r.id, r.value): r.score for r in secrets.literals(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert set(got) == {(1, token), (2, short), (4, short), (4, token), (4, "word00")}
    assert got[4, short] == pytest.approx(got[2, short] + 0.2) and got[1, token] == got[4, token]


def test_fetch_fallback_keeps_whole_pages(spark):
    want = set()
    for r in table(spark, SF, "pages").collect():
        failed, retried = r.page_id % 5 == 0, r.page_id % 10 == 0
        status, source = (201, "retry") if retried else (-1, None) if failed else (200, r.html)
        want.add((r.page_id, f"{r.url}~{r.page_id}", status, source))
    got = [tuple(r) for r in QUERIES["fetch_fallback"](spark, SF).select("page_id", "url", "status", "source_code").collect()]
    assert set(got) == want and len(got) == len(want)


def relevant(code):
    """The lines that may hold an API path, line by line and literal by literal."""
    kept = []
    for line in re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", code):
        line = line.strip(" \t\n\x0b\x0c\r")
        if line == "" or line.startswith("//") or len(line) > 800 or not any(w in line for w in ("/", "http", "api", "=", ":")):
            continue
        line = re.sub(r"(?<!:)//.*$", "", line).rstrip(" \t\n\x0b\x0c\r").replace("\\", "")
        if line == "" or re.search(r"<\s*(?:/\s*)?[A-Za-z][^>]*>", line):
            continue
        quoted = re.findall(r"""["'](.*?)["']""", line)
        if any(not x.lower().endswith(rules.SKIPPED) and not set(x) & set("\\|{}()[]$^?+*") and re.search(urls.JOINED_SLASH, x) for x in quoted):
            kept.append(" ".join(line.split()))
    return "\n".join(kept)


def test_relevant_lines_of_whole_table(spark, pages):
    def holds(sf_dir):
        got = {r.id: r.lines for r in QUERIES["relevant_lines"](spark, sf_dir).collect()}
        want = {r.page_id + 100: relevant(r.html) for r in table(spark, sf_dir, "pages").collect()} | {r[0]: r[3] for r in audit.SCRIPTS.rows}
        assert got == want
        return got

    holds(SF)
    got = holds(pages("var a = '/api/x';\n<p>'/api/y'</p>\nb = 'x'", "  get('/a/b')  // c\nget('/img/x.png')"))
    assert got[100] == "var a = '/api/x';" and got[101] == "get('/a/b')"


def answer_parts(answer):
    """The JSON of an answer, and the object that it is, if any."""
    a = (answer or "").strip(" ")
    fence, braces = re.search(r"(?is)`{3}(?:json)?[ \n\r\t]*(.*?)[ \n\r\t]*`{3}", a), re.search(r"(?s)\{.*\}", a)
    body = a.removesuffix("```").strip(" ") if a[:1] in ("{", "[") else fence[1] if fence else braces[0] if braces else ""
    try:
        return body, json.loads(body) if body.startswith("{") else None
    except ValueError:
        return body, None


TURNS = ['```json\n{"has_value": 0, "param_keys": ["id", "x"], "path": "", "method": "GET"}\n```', "no answer", 'so {"path": "/real", "params": "k=1"}', "{broken"]


@pytest.fixture
def turns(spark, tmp_path):
    rows = [(7, k, "assistant", x) for k, x in enumerate(TURNS)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_answers_of_whole_table(spark, turns):
    for at in (SF, turns):
        rows = [(r.conv_id, r.turn, r.text, f"/api/{r.conv_id}") for r in table(spark, at, "conversations").collect()]
        verdicts, advice = [], []
        for c, n, answer, path in rows + [(-r[0], 0, r[1], "") for r in audit.ANSWERS.rows]:
            body, x = answer_parts(answer)
            verdicts.append((c, n, body, (x or {}).get("has_value", 1), ",".join(k for k in (x or {}).get("param_keys", []) if len(k) > 1)))
        for c, n, answer, path in rows + [(-r[0], 0, r[2], r[1]) for r in audit.ADVICE.rows]:
            x = answer_parts(answer)[1]
            advice.append((c, n, *((x.get("path") or path, x.get("method"), x.get("params")) if x is not None else (None, None, None))))
        assert sorted(map(tuple, QUERIES["verdict_parse"](spark, at).collect())) == sorted(verdicts)
        assert sorted(map(tuple, QUERIES["advisory_parse"](spark, at).collect()), key=str) == sorted(advice, key=str)


def test_blacklist_of_whole_table(spark, pages):
    at = pages("a('/user/delete'); b('/user/list')")
    got = [tuple(r) for r in QUERIES["api_path_blacklist"](spark, at).collect()]
    assert sorted(got, key=str) == sorted([*web.PATH_CASES.rows, ("/user/delete", True, False), ("/user/list", False, True)], key=str)


def test_structural_truncate_keeps_pages_within_the_limit(spark, pages):
    whole, heads = "x" * 12_000, "function f(){ get(token) }" * 1_000
    got = {r.page_id: r.code for r in QUERIES["structural_truncate"](spark, pages(whole, whole + "y", heads)).collect()}
    assert got == {0: whole, 1: whole + text.CUT, 2: text.truncated(heads, 12_000)} and len(got[2]) > 9_000


def test_frontier_reaches_the_whole_table(spark):
    keys = [r.c_custkey for r in table(spark, SF, "customer").select("c_custkey").collect()]
    known = {k: 0 for k in keys if k % 100 == 1}
    level = set(known)
    for depth in range(1, 6):
        level = {t for k in level & set(keys) for t in ((k * 7 + 3) % len(keys) + 1, (k * 13 + 5) % len(keys) + 1)} - set(known)
        known |= dict.fromkeys(level, depth)
    got = [tuple(r) for r in QUERIES["crawl_frontier_depth"](spark, SF).select("node", "depth").collect()]
    assert dict(got) == known and len(got) == len(known)


def test_frontier_grows_with_the_table(spark, tmp_path):
    spark.range(1, 15_001).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    nodes = {r.node for r in QUERIES["crawl_frontier_depth"](spark, str(tmp_path)).collect()}
    assert len(nodes) > 2_000 and max(nodes) > 14_000
