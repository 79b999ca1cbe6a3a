import datetime

import pytest
from pyspark.sql import functions as F

from ferrule.functions import params, rules, text
from ferrule.operators import audit, crawl, dedup, findings
from ferrule.sources import tables
from ferrule.streaming import alerts

T0 = datetime.datetime(2024, 1, 1)


def at(*seconds):
    return [T0 + datetime.timedelta(seconds=s) for s in seconds]


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("# note\n b  c \n\nhttps://é.example/\n".encode())
    (tmp_path / "g.txt").write_bytes("网站\n".encode("gbk"))
    assert [r.line for r in tables.lines(spark, str(tmp_path / "u.txt")).collect()] == ["# note", "b c", "", "https://é.example/"]
    for encoding in ("gbk", None):
        assert [r.line for r in tables.lines(spark, str(tmp_path / "g.txt"), encoding).collect()] == ["网站"]
    assert [r.line for r in tables.lines(spark, str(tmp_path / "u.txt"), None).collect()] == ["# note", "b c", "", "https://é.example/"]
    assert [r.url for r in tables.url_list(tables.lines(spark, str(tmp_path / "u.txt"))).collect()] == ["b c", "https://é.example/"]


def test_state(spark, tmp_path):
    path = str(tmp_path / "visited")
    tables.truncate(spark, path, "visited_urls")
    first = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string")
    for want in ({"a", "b"}, {"a", "b"}):
        tables.append_new(dedup.new_keys(first, tables.state(spark, path, "url"), "url"), path)
        keys = [r.url for r in tables.state(spark, path, "url").collect()]
        assert set(keys) == want and len(keys) == len(want)
    tables.truncate(spark, path, "visited_urls")
    assert tables.state(spark, path, "url").count() == 0


def test_overflow_queue(spark, tmp_path):
    (tmp_path / "overflow_depth_2_x.txt").write_text("https://a/\n\nhttps://b/")
    (tmp_path / "other.txt").write_text("https://c/\n")
    got = {(r.url, r.depth) for r in tables.queue(spark, str(tmp_path)).collect()}
    assert got == {("https://a/", 2), ("https://b/", 2), ("https://c/", None)}


def test_csv_export(spark, tmp_path):
    f = spark.createDataFrame([("u", "GET", "High", "/a,b\nc", {"k": "1,2"}), ("v", "GET", "High", None, None), ("w", "GET", "Low", "/", None)], "api_endpoint string, http_method string, risk_level string, path string, params map<string,string>")
    tables.write_lines(findings.csv_lines(f).coalesce(1), str(tmp_path / "out"))
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got == ['"u","GET","High","/a;b c","k=1;2"', '"v","GET","High","",""'] and findings.header() == "URL,Method,Risk Level,Path,Params"


def test_keep_first_and_last_dont_depend_on_partitions(spark):
    rows = [(k, (i * 7) % 31, str(i)) for i in range(200) for k in ["a", None, "b"]]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    want = {k: min((n, v) for j, n, v in rows if j == k) for k in ("a", "b", None)}
    for parts in (1, 9):
        assert {r.k: (r.n, r.v) for r in dedup.keep_first(df.repartition(parts), ["k"], ["n", "v"]).collect()} == want
    assert {r.k: r.n for r in dedup.keep_last(df, ["k"], ["n", "v"]).collect()} == {"a": 30, "b": 30, None: 30}


def test_frontier(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "s"), ("c", None)], "source string, target string")
    seeds = spark.createDataFrame([("s",), (None,), ("s",)], "node string")
    assert {tuple(r) for r in crawl.frontier(seeds, edges, 2).collect()} == {("s", 0), ("a", 1), ("b", 1), ("c", 2)}
    assert {r.node for r in crawl.frontier(seeds, edges, 1).collect()} == {"s", "a", "b"}
    assert crawl.frontier(seeds.where("false"), edges).count() == 0


def test_rate_limit(spark):
    df = spark.createDataFrame([("k", t) for t in at(0, 30, 59, 60, 61, 119, 120, 130)] + [("j", T0), ("j", None)], "key string, ts timestamp")
    got = {(r.key, r.ts) for r in alerts.limited(df, "key").collect()}
    assert got == {("k", t) for t in at(0, 60, 120)} | {("j", T0)}


def test_rate_limit_stream(spark, tmp_path):
    src = tmp_path / "in"
    for i, times in enumerate([(0, 30, 59), (60, 61), (119, 120, 130)]):
        spark.createDataFrame([("k", t) for t in at(*times)] + [("j", at(times[0])[0])], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = alerts.limited_stream(stream, "key").writeStream.outputMode("append").format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r.key, r.ts) for r in spark.sql("SELECT * FROM sent").collect())
    finally:
        q.stop()
    assert {t for k, t in got if k == "k"} == set(at(0, 60, 120)) and {t for k, t in got if k == "j"} == set(at(0, 60)) | ({at(119)[0]} if at(119)[0] in {t for k, t in got if k == "j"} else set())


def test_cooldown(spark):
    df = spark.createDataFrame([(1,), (2,), (20,), (25,)], "n int")
    assert [r.s for r in df.select(alerts.cooldown(F.col("n")).alias("s")).collect()] == [30, 60, 600, 600]
    models = spark.createDataFrame([(1, False, T0 + datetime.timedelta(hours=1)), (2, False, T0), (3, True, None)], "rank int, is_available boolean, cooldown_until timestamp")
    assert alerts.available(models, F.lit(T0).cast("timestamp")).first()["rank"] == 2


def test_odd_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(params.headers(F.lit("{'A':'1', 'B' : '2','A':'3'}"))) == {"A": "3", "B": "2"}
    assert [get(params.unit_interval(F.lit(x))) for x in ("0.5", "1.5", "x")] == [0.5, None, None]
    assert get(params.to_text(F.create_map(F.lit("é"), F.lit("1")))) == '{"é":"1"}' and get(params.to_text(F.create_map().cast("map<string,string>"))) is None
    assert get(params.json_or_text(F.lit('{"a":1}')).cast("string")) == '{"a":1}' and get(params.json_or_text(F.lit("no")).cast("string")) == "no"
    assert get(text.first_pre(F.lit('<pre>x</pre><pre style="%s;"> a &lt;b </pre>' % "; ".join(["word-wrap: break-word", "white-space: pre-wrap"])))) == "a <b"
    assert get(text.break_lines(F.lit("a;b{" + "x" * (1 << 20)))).startswith("a;\nb{\nx") and get(text.break_lines(F.lit("a;b"))) == "a;b"
    assert "[function]" in get(params.judge_prompt(F.lit("/a"), F.lit("w"), F.array(F.lit("c")))) and get(params.advice_prompt(F.lit("/a"), F.lit("w"), F.array(F.lit("c")), F.array(F.lit("k")))).startswith("Parameter names seen: k")


@pytest.mark.parametrize("code", ["x" * 300, "function a(){}" * 40, "function f(){ get(token) }" * 40, "var q = 1; " + "function f(){ get(token) }" * 3 + "function g(){ }" * 30])
def test_truncate(code):
    cut = text.truncated(code, 200)
    assert len(cut) <= 300 and cut.split("\n\n/*")[0] in code and text.truncated(code, 10_000) == code


def test_audit(spark):
    script = 'function f(id){ return http.get("/api/user/" + id); } function g(){ f(7); }'
    paths = spark.createDataFrame([(" /api/user/ ", "https://a.example.com/x.js"), ("/api/user/", "https://a.example.com/y.js"), ("/api/del", "https://a.example.com/x.js"), ("/api/old", "https://a.example.com/x.js")], "api_path string, js_url string")
    todo = audit.candidates(paths, spark.createDataFrame([("/api/old",)], "api_path string"), spark.createDataFrame([], "api_path string"))
    assert [tuple(r) for r in todo.collect()] == [("/api/user/", "https://a.example.com/x.js")]
    found = audit.needs_verdict(audit.contexts(todo, spark.createDataFrame([("https://a.example.com/x.js", script)], "js_url string, source string")))
    assert found.count() == 1
    yes = audit.judged(found, spark.createDataFrame([("/api/user/", '{"has_value": 1, "param_keys": ["id"]}')], "api_path string, answer string"))
    no = audit.judged(found, spark.createDataFrame([("/api/user/", '{"has_value": 0}')], "api_path string, answer string"))
    assert yes.count() == 1 and no.count() == 0
    advice = audit.advised(yes.drop("verdict"), spark.createDataFrame([("/api/user/", '```json\n{"path": "", "method": "get", "params": "id=7"}\n```')], "api_path string, answer string"))
    (r,) = findings.api_findings(advice).collect()
    assert (r.api_endpoint, r.http_method, r.risk_level, r.path, r.params) == ("https://a.example.com/api/user/", "GET", "High", "/api/user/", {"id": "7"})


def test_containing_takes_short_paths(spark):
    lits = spark.createDataFrame([("xx/api/y",), ("/a",), ("none",), ("",)], "literal string")
    paths = spark.createDataFrame([("/a", 2), ("/api/y", 1), ("", 0)], "api_path string, rank int")
    assert {tuple(r) for r in audit.containing(lits, paths).collect()} == {("xx/api/y", "/api/y"), ("/a", "/a")}


def test_rule_tables():
    assert ".html" in rules.SKIPPED and ".js" not in rules.SKIPPED and ".js" in rules.PLAIN and ".html" not in rules.UNRECORDED
    assert (len(rules.SKIPPED), len(rules.PLAIN), len(rules.UNRECORDED), len(rules.LOGIN_WORDS), len(rules.HIGH_RISK), len(rules.MEDIUM_RISK), len(rules.METHODS)) == (22, 31, 21, 26, 22, 10, 7)
    assert (len(rules.HARMLESS_CODE), len(rules.PLAIN_VALUES), len(rules.SECRET_WORDS), len(rules.TECHNICAL_WORDS)) == (40, 31, 23, 16)
