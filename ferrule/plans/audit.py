"""Queries over text, responses, findings and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, extract, params, rules, text, urls
from ..operators import audit, crawl, dedup, findings, secrets
from ..streaming import alerts
from . import sqltext as S
from .common import Cases, q, query, read
from .web import _EDGES, _LINKS

# detectors: over all texts of the tables, and over cases that the tables lack

_A20 = "A" * 20
DETECT_CASES = Cases(
    "id bigint, text string",
    [
        (-1, "a13800138000b 138001380001 12800138000 13900139000,13900139001"),
        (-2, "bob@corp.io x@example.com icon@2x.png Eve@Sub.Corp.CN me@yourdomain.org"),
        (-3, "10.0.0.1 172.32.0.1 192.168.1.300 110.0.0.1 10.0.0.1234 172.16.9.9/172.31.9.9"),
        (-4, 'u="jdbc:mysql://h:3306/db" JDBC:oracle:thin:@h jdbc:oracle:thin://h/x'),
        (-5, "11010519491231002X 110105194913310021 x11010519491231002xy"),
        (-6, detect.KEY_HEADER + " abc"),
        (-7, 'password = "hunter22" pwd:\'12345\' passwd="undefined" PWD="s3cr3t-é"'),
        (-8, " ".join(f"https://{h}/{p}{_A20} https://{h}/{p}T1/B1/{_A20}" for h, p in detect.WEBHOOKS.items()) + f" HTTPS://hooks.Slack.com/services/{_A20}"),
        (-9, '"/v2/api-docs" /v2/api-docs \'/x/actuator/env\' "/Swagger-UI.html"'),
        (-10, "f();//# sourceMappingURL=app.js.map"),
        (-11, "f();//# sourceMappingURL=maps/app.js.map"),
        (-12, ""),
        (-13, None),
    ],
)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    return docs.select(F.col("doc_id").alias("id"), "text").unionByName(pages.select((F.col("page_id") + 1_000_000_000).alias("id"), F.col("html").alias("text"))).unionByName(DETECT_CASES.frame(spark))


_TEXTS = f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id + 1000000000, html FROM pages UNION ALL SELECT id, text FROM {DETECT_CASES.sql()}"


def _found(name: str) -> str:
    return f"SELECT DISTINCT id, {q(name)} AS detector, trim(value) AS value FROM (SELECT id, unnest({S.detector(name, 'text')}) AS value FROM ({_TEXTS}) WHERE length(text) <= {rules.MAX_REGEX_CHARS}) WHERE trim(value) <> '' AND length(trim(value)) <= {rules.MAX_FINDING_CHARS}"


def _detector(name: str) -> None:
    query(f"detect_{name}", _found(name))(lambda spark, sf_dir: detect.findings(_texts(spark, sf_dir), "id", "text", [name]))


for _name in detect.DETECTORS:
    _detector(_name)


@query("detect_all_union", " UNION ALL ".join(_found(n) for n in detect.DETECTORS))
def detect_all_union(spark, sf_dir):
    return detect.findings(_texts(spark, sf_dir), "id", "text")


#: What the detectors find in the cases, derived by hand from the rules, not from the patterns.
DETECT_FOUND = Cases(
    "id bigint, detector string, value string",
    [
        (-1, "phone", "13800138000"), (-1, "phone", "13900139000"), (-1, "phone", "13900139001"),
        (-2, "email", "bob@corp.io"), (-2, "email", "Eve@Sub.Corp.CN"),
        (-3, "private_ip", "10.0.0.1"), (-3, "private_ip", "192.168.1.300"), (-3, "private_ip", "172.16.9.9"), (-3, "private_ip", "172.31.9.9"),
        (-4, "jdbc", "jdbc:mysql://h:3306/db"), (-4, "jdbc", "jdbc:oracle:thin://h/x"),
        (-5, "resident_id", "11010519491231002X"), (-5, "resident_id", "11010519491231002x"),
        (-6, "private_key", "RSA Private Key Found"),
        (-7, "password", "Potential Password: hunter22"), (-7, "password", "Potential Password: s3cr3t-é"),
        (-8, "webhook", f"https://hooks.slack.com/services/{_A20}"), (-8, "webhook", f"https://open.feishu.cn/open-apis/bot/v2/hook/{_A20}"),
        (-8, "webhook", f"https://oapi.dingtalk.com/robot/send?access_token={_A20}"), (-8, "webhook", f"https://qyapi.weixin.qq.com/cgi-bin/webhook/send?key={_A20}"),
        (-8, "webhook", f"HTTPS://hooks.Slack.com/services/{_A20}"),
        (-9, "debug_endpoint", "/v2/api-docs"), (-9, "debug_endpoint", "/x/actuator/env"), (-9, "debug_endpoint", "/Swagger-UI.html"),
        (-10, "source_map", "SourceMap Found: app.js.map"),
    ],
)


@query("detect_cases", f"SELECT id, detector, value FROM {DETECT_FOUND.sql()}")
def detect_cases(spark, sf_dir):
    return detect.findings(DETECT_CASES.frame(spark), "id", "text")


@query("email_extract_raw", f"SELECT id, unnest(regexp_extract_all(text, {q(f'({detect.EMAIL})')}, 1)) AS email FROM ({_TEXTS})")
def email_extract_raw(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.explode(detect.emails_raw(F.col("text"))).alias("email"))


@query("literal_score")
def literal_score(spark, sf_dir):
    return secrets.literals(_texts(spark, sf_dir), "id", "text")


# text

PRE_CASES = Cases("id int, html string, expected string", [(1, "<html><pre>a</pre><pre>b</pre></html>", "a\nb"), (2, 'var a="<pre>x</pre>"', 'var a="<pre>x</pre>"'), (3, " <PRE class='x'>c\nd</PRE>", "c\nd"), (4, "<p>none</p>", "<p>none</p>"), (5, None, None)])


@query("pre_unwrap", f"SELECT id, expected AS body FROM {PRE_CASES.sql()} UNION ALL SELECT CAST(page_id + 100 AS INTEGER), html FROM pages WHERE NOT regexp_matches(html, '(?i)<pre')")
def pre_unwrap(spark, sf_dir):
    rows = PRE_CASES.frame(spark).select("id", "html").unionByName(read(spark, sf_dir, "pages").select((F.col("page_id") + 100).cast("int").alias("id"), "html"))
    return rows.select("id", text.unwrap_pre(F.col("html")).alias("body"))


RESPONSES = Cases("id bigint, body string", [(-1, '{"requestId": "a1", "x": 1}'), (-2, '{ "requestId" :"b2","x":1 }'), (-3, '{"timestamp": 17, "sign":"s", "nonce":"n", "uuid":"u", "traceId":"t"}'), (-4, ""), (-5, None)])


@query("response_fingerprint", f"SELECT id, {S.normalized('body')} AS normalized, md5({S.normalized('body')}) AS fingerprint FROM (SELECT event_id AS id, props AS body FROM events UNION ALL SELECT id, body FROM {RESPONSES.sql()})")
def response_fingerprint(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("body")).unionByName(RESPONSES.frame(spark))
    return rows.select("id", text.normalize_response(F.col("body")).alias("normalized"), text.fingerprint(F.col("body")).alias("fingerprint"))


_STATUS = [200, 201, 301, 302, 401, 403, 404, 405, 500]
#: Events as recorded responses.
_RESPONSES = f"SELECT 'https://example.com/u/' || user_id AS url, CAST(list_extract({_STATUS}, CAST(event_id % {len(_STATUS)} AS INTEGER) + 1) AS INTEGER) AS status_code, event_id AS seq FROM events"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("https://example.com/u/"), F.col("user_id").cast("string")).alias("url"), F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % len(_STATUS) + 1).cast("int")).alias("status_code"), F.col("event_id").alias("seq"))


_PRIORITY = "CASE WHEN status_code IN (401, 403) OR status_code >= 500 THEN 3 WHEN status_code = 404 THEN 1 ELSE 2 END"


@query("status_best_per_url", f"SELECT url, arg_max(status_code, ({_PRIORITY}, -seq)) AS status_code, arg_max(seq, ({_PRIORITY}, -seq)) AS seq, CAST(count(*) - 1 AS BIGINT) AS duplicates FROM ({_RESPONSES}) GROUP BY url")
def status_best_per_url(spark, sf_dir):
    return dedup.best_response(_responses(spark, sf_dir))


@query(
    "probe_two_round",
    f"""WITH r AS ({_RESPONSES}), post AS (SELECT * FROM r WHERE seq % 2 = 0), got AS (SELECT * FROM r WHERE seq % 2 = 1)
    SELECT url, status_code, seq FROM post WHERE status_code <> 405 UNION ALL SELECT url, status_code, seq FROM post WHERE status_code = 405 AND url NOT IN (SELECT url FROM got)
    UNION ALL SELECT url, status_code, seq FROM got WHERE url IN (SELECT url FROM post WHERE status_code = 405)""",
)
def probe_two_round(spark, sf_dir):
    r = _responses(spark, sf_dir)
    return crawl.two_rounds(r.where("seq % 2 = 0"), r.where("seq % 2 = 1"))


@query(
    "probe_stats",
    f"""WITH r AS ({_RESPONSES}), post AS (SELECT *, seq % 10 = 0 AS bad FROM r WHERE seq % 2 = 0), got AS (SELECT * FROM r WHERE seq % 2 = 1)
    SELECT CAST(count(*) AS BIGINT) AS total_urls, CAST(count_if(NOT bad AND status_code <> 405) AS BIGINT) AS post_only, CAST(count_if(NOT bad AND status_code = 405) AS BIGINT) AS n405,
    CAST(count(*) + count_if(NOT bad AND status_code = 405) AS BIGINT) AS total_requests,
    (SELECT CAST(count(*) AS BIGINT) FROM got WHERE url IN (SELECT url FROM post WHERE NOT bad AND status_code = 405)) AS post_then_get FROM post""",
)
def probe_stats(spark, sf_dir):
    r = _responses(spark, sf_dir).withColumn("error", F.when(F.col("seq") % 10 == 0, "timeout"))
    return crawl.probe_stats(r.where("seq % 2 = 0"), r.where("seq % 2 = 1"))


@query("fetch_fallback")
def fetch_fallback(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit("~"), F.col("page_id").cast("string")))
    failed = F.col("page_id") % 5 == 0
    pages = p.select("page_id", "url", F.when(failed, -1).otherwise(200).alias("status"), F.when(~failed, F.col("html")).alias("source_code"))
    retried = p.where(failed).select("url", F.lit(201).alias("status_code"), F.lit("retry").alias("response_content"), F.when(F.col("page_id") % 2 == 1, "no").alias("error"), F.col("page_id").alias("seq"))
    return crawl.with_fallback(pages, retried)


@query("fetch_fallback_heads", "SELECT page_id, url, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 201 WHEN page_id % 5 = 0 THEN -1 ELSE 200 END AS status, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'retry' WHEN page_id % 5 <> 0 THEN left(html, 20) END AS source_code FROM (SELECT page_id, url || '~' || page_id AS url, html FROM pages)")
def fetch_fallback_heads(spark, sf_dir):
    """fetch_fallback with the first characters of each source, for SQL."""
    return fetch_fallback(spark, sf_dir).withColumn("source_code", F.left("source_code", F.lit(20)))


#: Each page as it was fetched: its status, how often it was sent on (null for not at all), some without a body.
_FETCHED = f"SELECT CAST(list_extract({_STATUS}, CAST(page_id % {len(_STATUS)} AS INTEGER) + 1) AS INTEGER) AS status, CASE WHEN page_id % 4 < 3 THEN CAST(page_id % 4 AS INTEGER) END AS redirect_count, CASE WHEN page_id % 11 <> 0 THEN html ELSE '' END AS html FROM pages"


@query(
    "redirect_stats",
    f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(status BETWEEN 200 AND 399) AS BIGINT) AS success, CAST(count_if(status NOT BETWEEN 200 AND 399) AS BIGINT) AS error,
    CAST(count_if(status BETWEEN 200 AND 399 AND coalesce(redirect_count, 0) = 0) AS BIGINT) AS redirect_0, CAST(count_if(status BETWEEN 200 AND 399 AND redirect_count = 1) AS BIGINT) AS redirect_1,
    CAST(count_if(status BETWEEN 200 AND 399 AND redirect_count > 1) AS BIGINT) AS redirect_loop FROM ({_FETCHED}) WHERE html <> ''""",
)
def redirect_stats(spark, sf_dir):
    n = F.col("page_id")
    fetched = read(spark, sf_dir, "pages").select(F.element_at(F.array(*map(F.lit, _STATUS)), (n % len(_STATUS) + 1).cast("int")).alias("status"), F.when(n % 4 < 3, (n % 4).cast("int")).alias("redirect_count"), F.when(n % 11 != 0, F.col("html")).otherwise("").alias("html"))
    return crawl.redirect_stats(fetched)


QUICK_CASES = Cases(
    "url string, status int, snippet string, expected string",
    [("/x", 401, "any", "0"), ("/x", 200, '{"ok":1}', "1"), ("/x", 200, "<HTML>", "0"), ("/x", 404, "<html>", "1"), ("/x", 200, "Please login", "0"), ("/x", 300, "login", "0"), ("/x", 302, "login", "1"), ("/x", 200, '{"id":4013}', "0"), ("/a.css", 200, "{}", "0"), ("/x", 503, "会话过期", "0"), ("/x", 200, None, "1"), ("/x", 200, "x" * 600 + "login", "1")],
)


@query("quick_scan_verdict", f"SELECT url, status, snippet, expected AS verdict FROM {QUICK_CASES.sql()}")
def quick_scan_verdict(spark, sf_dir):
    return QUICK_CASES.frame(spark).select("url", "status", "snippet", extract.quick_verdict(F.col("url"), F.col("status"), F.col("snippet")).alias("verdict"))


@query("js_minify", f"SELECT page_id AS id, {S.chain('html', text.MINIFY)} AS code FROM pages")
def js_minify(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.minify(F.col("html")).alias("code"))


SCRIPTS = Cases(
    "id int, code string, minified string, relevant string",
    [
        (1, 'var a = "/api/x"; // note', 'var a = "/api/x"; ', 'var a = "/api/x";'),
        (2, 'var a = "/img/x.png"', 'var a = "/img/x.png"', ""),
        (3, '// "/api/x"', "", ""),
        (4, "a();/* b\n c */console.log(1);logger.warn('x') ;d()", "a();; ;d()", ""),
        (5, "s = '<b class=x>t</b>';\n\n\tu =  \"/api/y\"  ;", 's = "[HTML]"; u = "/api/y" ;', 'u = "/api/y" ;'),
        (6, "i = 'image/png;base64,AAAA'; c = '.a { b: c }'", 'i = "[IMG]"; c = "[CSS]"', "i = 'image/png;base64,AAAA'; c = '.a { b: c }'"),
        (7, 'p = "https://a.example.com/v1" ; q = "\\/api\\/z"', 'p = "https:', 'p = "https://a.example.com/v1" ; q = "/api/z"'),
    ],
)


@query("js_minify_cases", f"SELECT id, minified FROM {SCRIPTS.sql()}")
def js_minify_cases(spark, sf_dir):
    return SCRIPTS.frame(spark).select("id", text.minify(F.col("code")).alias("minified"))


@query("relevant_lines")
def relevant_lines(spark, sf_dir):
    rows = SCRIPTS.frame(spark).select(F.col("id").cast("bigint").alias("id"), "code").unionByName(read(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("id"), F.col("html").alias("code")))
    return rows.select("id", text.relevant_lines(F.col("code")).alias("lines"))


@query("relevant_lines_cases", f"SELECT id, relevant AS lines FROM {SCRIPTS.sql()}")
def relevant_lines_cases(spark, sf_dir):
    return SCRIPTS.frame(spark).select("id", text.relevant_lines(F.col("code")).alias("lines"))


@query("js_sanitize", r"SELECT doc_id, regexp_replace(text || chr(8203) || chr(7) || chr(8232) || 'x', '[' || chr(8203) || chr(7) || ']', '', 'g').replace(chr(8232), chr(10)) AS code FROM documents")
def js_sanitize(spark, sf_dir):
    tail = F.lit("\u200b\x07\u2028x")
    return read(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.concat("text", tail)).alias("code"))


@query("structural_truncate")
def structural_truncate(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.structural_truncate(F.col("html"), text.CODE_CHARS).alias("code"))


ANSWERS = Cases(
    "id int, answer string, body string, has_value int, param_keys string",
    [
        (1, '<think>hm</think>```json\n{"has_value": 0, "param_keys": ["a", "id", "name"]}\n```', '{"has_value": 0, "param_keys": ["a", "id", "name"]}', 0, "id,name"),
        (2, 'Sure: {"param_keys": []} ok', '{"param_keys": []}', 1, ""),
        (3, "nothing", "", 1, ""),
        (4, '[{"has_value": 0}]', '[{"has_value": 0}]', 1, ""),
        (5, None, "", 1, ""),
        (6, '{"has_value": 1}```', '{"has_value": 1}', 1, ""),
        (7, "{broken", "{broken", 1, ""),
    ],
)


@query("verdict_parse")
def verdict_parse(spark, sf_dir):
    """All turns as a model's answers, and the cases as turns of conversations below 0."""
    rows = ANSWERS.frame(spark).select((-F.col("id")).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), "answer")
    rows = rows.unionByName(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer")))
    v = params.verdict(F.col("answer"))
    return rows.select("conv_id", "turn", text.json_part(F.col("answer")).alias("body"), v["has_value"].alias("has_value"), F.array_join(v["param_keys"], ",").alias("param_keys"))


@query("verdict_parse_cases", f"SELECT id, body, has_value, param_keys FROM {ANSWERS.sql()}")
def verdict_parse_cases(spark, sf_dir):
    v = params.verdict(F.col("answer"))
    return ANSWERS.frame(spark).select("id", text.json_part(F.col("answer")).alias("body"), v["has_value"].alias("has_value"), F.array_join(v["param_keys"], ",").alias("param_keys"))


ADVICE = Cases(
    "id int, api_path string, answer string, path string, method string, params string",
    [(1, "/api/a", '```json\n{"path": "", "method": "post", "params": "k=1"}```', "/api/a", "post", "k=1"), (2, "/api/b", '{"path": "/real", "method": "GET"}', "/real", "GET", None), (3, "/api/c", "no", None, None, None), (4, "/api/d", None, None, None, None)],
)


@query("advisory_parse")
def advisory_parse(spark, sf_dir):
    """All turns as a model's answers, each about its conversation's path, and the cases as turns of conversations below 0."""
    rows = ADVICE.frame(spark).select((-F.col("id")).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), "api_path", "answer")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("/api/"), F.col("conv_id").cast("string")).alias("api_path"), F.col("text").alias("answer"))
    a = params.advisory(F.col("answer"), F.col("api_path"))
    return rows.unionByName(turns).select("conv_id", "turn", a["path"].alias("path"), a["method"].alias("method"), a["params"].alias("params"))


@query("advisory_parse_cases", f"SELECT id, path, method, params FROM {ADVICE.sql()}")
def advisory_parse_cases(spark, sf_dir):
    a = params.advisory(F.col("answer"), F.col("api_path"))
    return ADVICE.frame(spark).select("id", a["path"].alias("path"), a["method"].alias("method"), a["params"].alias("params"))


@query("fence_strip", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace('<think>' || role || '</think>```json ' || text || ' ```', '(?is)<think>.*?</think>', '', 'g'), '```(?:json)?', '', 'g')) AS answer FROM conversations")
def fence_strip(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.without_fences(F.concat(F.lit("<think>"), "role", F.lit("</think>```json "), "text", F.lit(" ```"))).alias("answer"))


@query("topk_callers", "SELECT conv_id, string_agg('--- call ' || n || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS callers FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def topk_callers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return c.select("conv_id", params.numbered(F.col("texts")).alias("callers"))


# parameters, methods, risk

METHOD_CASES = Cases("method string, stored string, replayed string", [("get", "GET", "GET"), (" Put ", "PUT", "PUT"), ("DELETE", "DELETE", "GET"), ("FOO", "UNKNOWN", "GET"), ("", "UNKNOWN", "GET"), (None, "UNKNOWN", "GET")])


@query("method_normalize", f"SELECT method, stored, replayed FROM {METHOD_CASES.sql()}")
def method_normalize(spark, sf_dir):
    m = F.col("method")
    return METHOD_CASES.frame(spark).select("method", params.stored_method(m).alias("stored"), params.replayed_method(m).alias("replayed"))


PARAM_CASES = Cases("id int, text string, key string, value string", [(1, "a=1,b=2,a=3", "a", "3"), (1, "a=1,b=2,a=3", "b", "2"), (2, "[x=1, y]", "x", "1"), (2, "[x=1, y]", "y", ""), (3, "k=v=w", "k", "v=w"), (4, " , z = 1 ,", "z", "1")])


@query("params_parse_storage", f"SELECT id, key, value FROM {PARAM_CASES.sql()}")
def params_parse_storage(spark, sf_dir):
    rows = PARAM_CASES.frame(spark).select("id", "text").distinct().unionByName(spark.createDataFrame([(8, ""), (9, "[]"), (10, None)], "id int, text string"))
    return rows.select("id", F.explode(params.stored(F.col("text"))))


REPLAY_CASES = Cases("id bigint, text string, key string, value string", [(-1, '{"a":1}', "a", "1"), (-2, "a=1&b=2", "a", "1"), (-2, "a=1&b=2", "b", "2"), (-3, "a=1,b=2&c", "a", "1"), (-3, "a=1,b=2&c", "b", "2&c"), (-4, "{bad", "{bad", "")])


@query("params_parse_replay", f"SELECT event_id AS id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events UNION ALL SELECT id, key, value FROM {REPLAY_CASES.sql()}")
def params_parse_replay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text")).unionByName(REPLAY_CASES.frame(spark).select("id", "text").distinct())
    return rows.select("id", F.explode(params.replayed(F.col("text"))))


@query("params_to_text", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS csv FROM events")
def params_to_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", params.to_csv(params.replayed(F.col("props"))).alias("csv"))


RISK_CASES = Cases("path string, method string, params string, expected string", [("/ping", "GET", "", "Med"), ("/ping", "POST", "", "Low"), ("/ping", "DELETE", "", "High"), ("/api/list", "POST", "", "Med"), ("/border", "POST", "", "High"), ("/author", "POST", "", "High"), ("/ping", "POST", "token=1", "High")])


@query("risk_score_cases", f"SELECT path, method, params, expected AS risk FROM {RISK_CASES.sql()}")
def risk_score_cases(spark, sf_dir):
    return RISK_CASES.frame(spark).select("path", "method", "params", params.risk(F.col("path"), F.col("method"), params.stored(F.col("params"))).alias("risk"))


_RISK_TEXT = "text || ' POST '"


@query("risk_score", f"SELECT doc_id, {S.risk(_RISK_TEXT)} AS risk FROM documents")
def risk_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", params.risk(F.col("text"), F.lit("POST")).alias("risk"))


@query("risk_rollup", f"SELECT source, risk, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, {S.risk(_RISK_TEXT)} AS risk FROM documents) GROUP BY GROUPING SETS ((source, risk), (risk), ())")
def risk_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", params.risk(F.col("text"), F.lit("POST")).alias("risk"))
    counted = d.groupBy("source", "risk").agg(F.count("*").alias("n"))
    return counted.groupingSets([["source", "risk"], ["risk"], []], "source", "risk").agg(F.sum("n").alias("n"))


# findings: links as advice, written twice, the second time by other pages

_ADVICE = f"SELECT url AS js_url, link AS api_endpoint, CASE WHEN page_id % 2 = 0 THEN 'post' ELSE 'brew' END AS method, link AS path, 'k=' || page_id || ',user=' AS params, page_id AS seq, page_id % 3 = 0 AS late FROM ({_LINKS}) WHERE {S.api_path('link')}"
_KEYED = f"SELECT 'https://js.example.com/' || (seq % 20) || '.js' AS js_url, api_endpoint, method, path, params, seq FROM ({_ADVICE})"
_LAST = f"SELECT js_url, api_endpoint, arg_max(method, seq) AS method, arg_max(path, seq) AS path, arg_max(params, seq) AS params, max(seq) AS seq FROM ({_KEYED}) GROUP BY js_url, api_endpoint"
_METHOD = "CASE WHEN method = 'post' THEN 'POST' ELSE 'UNKNOWN' END"
_VULNS = f"SELECT js_url, api_endpoint, {_METHOD} AS http_method, {S.risk(f'path || chr(32) || {_METHOD} || chr(32) || params')} AS risk_level, path, seq FROM ({_LAST})"


def _vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(extract.links(F.col("html"))).alias("link")).where(extract.is_api_path(F.col("link")))
    n = F.col("page_id").cast("string")
    advice = links.select(F.concat(F.lit("https://js.example.com/"), (F.col("page_id") % 20).cast("string"), F.lit(".js")).alias("js_url"), F.col("link").alias("api_endpoint"), F.when(F.col("page_id") % 2 == 0, "post").otherwise("brew").alias("method"), F.col("link").alias("path"), F.concat(F.lit("k="), n, F.lit(",user=")).alias("params"), F.col("page_id").alias("seq"))
    return findings.api_findings(advice)


@query("finding_upsert_last", _VULNS)
def finding_upsert_last(spark, sf_dir):
    v = _vulns(spark, sf_dir)
    old = v.where("seq % 2 = 0").withColumns({"risk_level": F.lit("stale"), "seq": F.col("seq") - 1_000_000})
    return findings.upsert(old, v, ["js_url", "api_endpoint"]).select("js_url", "api_endpoint", "http_method", "risk_level", "path", "seq")


@query("replay_update_join", f"SELECT js_url, api_endpoint, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 'success' ELSE 'failed' END END AS request_status, CAST(CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 200 ELSE -1 END END AS INTEGER) AS response_code, CAST(CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN length(api_endpoint) ELSE 0 END END AS INTEGER) AS response_length FROM ({_VULNS})")
def replay_update_join(spark, sf_dir):
    v = _vulns(spark, sf_dir).withColumn("id", F.concat("js_url", "api_endpoint"))
    even = F.col("seq") % 2 == 0
    replays = v.where("seq % 3 = 0").select("id", F.when(even, 200).otherwise(-1).alias("status_code"), F.when(even, F.col("api_endpoint")).alias("content_summary"))
    return findings.apply_replays(v, replays).select("js_url", "api_endpoint", "request_status", "response_code", "response_length")


_SENSITIVE = f"SELECT 'https://js.example.com/' || (id % 25) || '.js' AS js_url, value AS sensitive_value, CASE WHEN id % 2 = 0 THEN 'High' ELSE 'Low' END AS risk_level, 'email' AS secret_type, max(id) AS seq FROM (SELECT id, unnest(regexp_extract_all(text, {q(f'({detect.EMAIL})')}, 1)) AS value FROM ({_TEXTS})) GROUP BY ALL"
_SENSITIVE = f"SELECT js_url, sensitive_value, arg_max(risk_level, seq) AS risk_level, 'email' AS secret_type, max(seq) AS seq FROM ({_SENSITIVE}) GROUP BY js_url, sensitive_value"


def _sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = email_extract_raw(spark, sf_dir)
    items = raw.select(F.concat(F.lit("https://js.example.com/"), (F.col("id") % 25).cast("string"), F.lit(".js")).alias("js_url"), F.col("email").alias("sensitive_value"), F.when(F.col("id") % 2 == 0, "High").otherwise("Low").alias("risk_level"), F.lit("email").alias("secret_type"), F.col("id").alias("seq"))
    return findings.sensitive_findings(items)


@query("sensitive_upsert_last", _SENSITIVE)
def sensitive_upsert_last(spark, sf_dir):
    return _sensitive(spark, sf_dir)


@query("linked_report", f"SELECT coalesce(v.js_url, s.js_url) AS js_url, coalesce(v.n, 0) AS vuln_count, coalesce(v.h, 0) AS high_vuln_count, coalesce(s.n, 0) AS sensitive_count, coalesce(s.h, 0) AS high_sensitive_count FROM (SELECT js_url, CAST(count(*) AS BIGINT) AS n, CAST(count_if(risk_level = 'High') AS BIGINT) AS h FROM ({_VULNS}) GROUP BY js_url) v FULL JOIN (SELECT js_url, CAST(count(*) AS BIGINT) AS n, CAST(count_if(risk_level = 'High') AS BIGINT) AS h FROM ({_SENSITIVE}) GROUP BY js_url) s ON v.js_url = s.js_url")
def linked_report(spark, sf_dir):
    return findings.linked_report(_vulns(spark, sf_dir), _sensitive(spark, sf_dir))


@query(
    "stats_report",
    f"""SELECT 'ai_vulns' AS section, 'total' AS metric, NULL AS value, CAST(count(*) AS BIGINT) AS n FROM ({_VULNS}) UNION ALL SELECT 'ai_vulns', 'by_risk', risk_level, count(*) FROM ({_VULNS}) GROUP BY risk_level
    UNION ALL SELECT 'sensitive_info', 'total', NULL, count(*) FROM ({_SENSITIVE}) UNION ALL SELECT 'sensitive_info', 'by_risk', risk_level, count(*) FROM ({_SENSITIVE}) GROUP BY risk_level
    UNION ALL SELECT 'sensitive_info', 'by_type', secret_type, count(*) FROM ({_SENSITIVE}) GROUP BY secret_type
    UNION ALL SELECT 'scan_results', 'total', NULL, count(*) FROM ({_LINKS}) UNION ALL SELECT 'visited_urls', 'total', NULL, count(*) FROM pages""",
)
def stats_report(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return findings.stats(_vulns(spark, sf_dir), _sensitive(spark, sf_dir), pages.select(F.explode(extract.links(F.col("html")))), pages.select("page_id"))


@query("export_high_risk", f"""SELECT '"' || api_endpoint || '","' || http_method || '","High","' || replace(replace(path, ',', ';'), chr(10), ' ') || '","k=' || seq || ';user="' AS line FROM ({_VULNS}) WHERE risk_level = 'High'""")
def export_high_risk(spark, sf_dir):
    return findings.csv_lines(_vulns(spark, sf_dir))


@query("findings_by_risk", f"SELECT js_url, api_endpoint, seq FROM ({_VULNS}) WHERE risk_level = 'High'")
def findings_by_risk(spark, sf_dir):
    v = _vulns(spark, sf_dir).withColumns({"created_at": F.timestamp_seconds("seq"), "id": F.concat("js_url", "api_endpoint")})
    return findings.where(v, "risk_level", "High").select("js_url", "api_endpoint", "seq")


@query("literal_contains_path")
def literal_contains_path(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select(F.explode(extract.links(F.col("html"))).alias("literal"))
    paths = links.where(extract.is_api_path(F.col("literal"))).select(F.col("literal").alias("api_path")).distinct()
    return audit.containing(links, paths.withColumn("rank", F.struct(F.length("api_path").alias("n"), "api_path")))


@query("literal_contains_short_path", f"""WITH p AS (SELECT DISTINCT link AS api_path FROM ({_LINKS}) WHERE {S.api_path('link')} AND length(link) < 9), l AS (SELECT DISTINCT link AS literal FROM ({_LINKS}))
    SELECT literal, arg_min(api_path, (length(api_path), api_path)) AS api_path FROM l JOIN p ON contains(literal, api_path) GROUP BY literal""")
def literal_contains_short_path(spark, sf_dir):
    """Those of literal_contains_path whose path is short. Paths are ranked by length, so SQL can look for short ones only."""
    return literal_contains_path(spark, sf_dir).where(F.length("api_path") < 9)


@query("audit_candidates", f"SELECT link AS api_path, min(url) AS js_url FROM ({_LINKS}) WHERE length(trim(link)) >= 4 AND NOT regexp_matches(link, '^(?:http|//)') AND NOT {S.ends('lower(link)', rules.NOT_API)} AND NOT {S.blacklisted('link')} AND link NOT IN (SELECT link FROM ({_LINKS}) WHERE page_id < 20) GROUP BY link")
def audit_candidates(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("js_url"), F.explode(extract.links(F.col("html"))).alias("api_path"))
    return audit.candidates(found.drop("page_id"), found.where("page_id < 20").select("api_path"))


@query("ast_api_context")
def ast_api_context(spark, sf_dir):
    """Every page that names API paths, its script elements as one script: wrapper code and callers of each path.

    United with scripts made of the pages' links (a wrapper, a constant and two callers each), as few pages call any.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "html", F.explode(extract.links(F.col("html"))).alias("link"))
    paths = pages.where(extract.is_api_path(F.col("link"))).select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("js_url"), F.col("link").alias("api_path"))
    scripts = read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("js_url"), F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n").alias("source"))
    one = paths.groupBy("js_url").agg(F.sort_array(F.collect_set("api_path")).alias("api_paths"))
    body = F.array_join(F.transform("api_paths", lambda p, i: F.concat(F.lit("function f"), i.cast("string"), F.lit("(id){ return http.get(BASE + '"), p, F.lit("' + id); } function g"), i.cast("string"), F.lit("(){ f"), i.cast("string"), F.lit("(1); }\n"))), "")
    made = one.select(F.concat(F.lit("made/"), F.col("js_url")).alias("js_url"), F.concat(F.lit("const BASE = '/v1';\n"), body).alias("source"))
    made_paths = paths.withColumn("js_url", F.concat(F.lit("made/"), F.col("js_url")))
    return audit.contexts(paths.unionByName(made_paths), scripts.unionByName(made))


# alerts

_GAP = "60000000"


@query(
    "alert_rate_limit",
    f"""WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL), s AS (SELECT event_type, min(t) AS t FROM e GROUP BY event_type
    UNION ALL SELECT s.event_type, (SELECT min(e.t) FROM e WHERE e.event_type = s.event_type AND e.t >= s.t + {_GAP}) FROM s WHERE s.t IS NOT NULL)
    SELECT event_type, make_timestamp(t) AS ts FROM s WHERE t IS NOT NULL""",
)
def alert_rate_limit(spark, sf_dir):
    return alerts.limited(read(spark, sf_dir, "events"), "event_type")


@query(
    "model_cooldown",
    """WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, count_if(ok) OVER (PARTITION BY user_id ORDER BY ts, ok, event_id) AS run FROM e),
    c AS (SELECT *, count_if(NOT ok) OVER (PARTITION BY user_id, run ORDER BY ts, ok, event_id) AS errors FROM r)
    SELECT user_id, CAST(count(*) AS BIGINT) AS outcomes, CAST(max(errors) AS BIGINT) AS most_errors, CAST(sum(least(30 * errors, 600)) AS BIGINT) AS seconds FROM c GROUP BY user_id""",
)
def model_cooldown(spark, sf_dir):
    """Users as models, their events as outcomes: a success takes the count of errors back to none."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("model"), "ts", F.struct(F.col("event_type") != "error", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    states = alerts.model_states(e)
    return states.groupBy(F.col("model").alias("user_id")).agg(F.count("*").alias("outcomes"), F.max("error_count").alias("most_errors"), F.sum("seconds").cast("bigint").alias("seconds"))


OUTCOMES = Cases(
    "model string, ts_s bigint, ok boolean, error_count bigint, seconds bigint, until_s bigint",
    [("a", 10, False, 1, 30, 40), ("a", 20, False, 2, 60, 80), ("a", 30, True, 0, 0, None), ("a", 40, False, 1, 30, 70), ("b", 5, True, 0, 0, None)] + [("c", t, False, t, min(30 * t, 600), t + min(30 * t, 600)) for t in range(1, 24)],
)


@query("model_cooldown_cases", f"SELECT model, ts_s, error_count, seconds, until_s FROM {OUTCOMES.sql()}")
def model_cooldown_cases(spark, sf_dir):
    rows = OUTCOMES.frame(spark).select("model", "ts_s", F.timestamp_seconds("ts_s").alias("ts"), "ok")
    return alerts.model_states(rows).select("model", "ts_s", F.col("error_count").cast("bigint"), F.col("seconds").cast("bigint"), F.unix_seconds("cooldown_until").alias("until_s"))


# the funnel of the audit: probes, verdicts, advice

#: Recorded answers of every URL that a link of an API path resolves to.
_PROBE = "CAST(CASE WHEN length({u}) % 5 = 0 THEN 401 WHEN length({u}) % 5 = 1 THEN 404 ELSE 200 END AS INTEGER)"
_SNIPPET = "CASE WHEN length({u}) % 3 = 0 THEN '<!DOCTYPE html>' WHEN length({u}) % 3 = 1 THEN 'Please login' ELSE '{{\"ok\":1}}' END"
_PATHS = f"SELECT trim(link) AS api_path, url AS js_url, CASE WHEN target IS NOT NULL THEN target WHEN starts_with(trim(link), 'http') THEN trim(link) ELSE {S.scheme('url')} || '://' || {S.netloc('url')} || trim(link) END AS full_url FROM ({{edges}}) WHERE length(trim(link)) >= 4 AND NOT {S.blacklisted('trim(link)')}"


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "pages").select(F.col("url").alias("js_url"), F.explode(extract.links(F.col("html"))).alias("api_path"))
    full = F.coalesce(urls.resolve(F.col("api_path"), F.col("js_url")), urls.prefixed(F.col("api_path"), F.col("js_url")))
    n = F.length("url")
    probes = paths.select(full.alias("url")).distinct().where(n % 7 != 0)
    probes = probes.select("url", F.when(n % 5 == 0, 401).when(n % 5 == 1, 404).otherwise(200).alias("status_code"), F.when(n % 3 == 0, "<!DOCTYPE html>").when(n % 3 == 1, "Please login").otherwise('{"ok":1}').alias("response_content"))
    return audit.probed(paths, probes)


_PROBED = f"SELECT api_path, js_url, full_url, {_PROBE.format(u='full_url')} AS status_code FROM ({_PATHS.format(edges=_EDGES)}) WHERE length(full_url) % 7 <> 0"


@query("probe_join", _PROBED)
def probe_join(spark, sf_dir):
    return _probed(spark, sf_dir).select("api_path", "js_url", "full_url", "status_code")


_ANSWERED = "status_code BETWEEN 200 AND 300"
_QUALIFIED = f"WITH p AS MATERIALIZED ({_PROBED}) SELECT DISTINCT api_path FROM p WHERE status_code <> 401 AND NOT {S.ends(S.lower_cut('full_url'), rules.SKIPPED)} AND NOT ({_ANSWERED} AND length(full_url) % 3 < 2)"


@query("probe_qualified", _QUALIFIED)
def probe_qualified(spark, sf_dir):
    return audit.qualified(_probed(spark, sf_dir))


@query("audit_funnel", "WITH c AS (SELECT DISTINCT '/api/' || conv_id AS p FROM conversations), a AS (SELECT DISTINCT '/api/' || conv_id AS p FROM conversations WHERE turn % 2 = 1 AND conv_id % 3 = 0) SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(a.p) AS BIGINT) AS success FROM c LEFT JOIN a ON c.p = a.p")
def audit_funnel(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("api_path", F.concat(F.lit("/api/"), F.col("conv_id").cast("string")))
    return audit.funnel(c, c.where("turn % 2 = 1 AND conv_id % 3 = 0"))


PREFIX_CASES = Cases("found string, base string, expected string", [("/v1/x", "https://a.com:8/b/c.js?q", "https://a.com:8/v1/x"), ("x/y", "http://a.com/b", "http://a.comx/y"), ("http://b.com/x", "https://a.com/", "http://b.com/x"), ("httpd", "https://a.com/", "httpd")])


@query("url_prefix_cases", f"SELECT found, base, expected AS full_url FROM {PREFIX_CASES.sql()}")
def url_prefix_cases(spark, sf_dir):
    return PREFIX_CASES.frame(spark).select("found", "base", urls.prefixed(F.col("found"), F.col("base")).alias("full_url"))


# what the reports and the read side give

_ITEM = "api_endpoint || '|' || risk_level"


@query(
    "linked_report_items",
    f"""WITH v AS (SELECT js_url, count(*) AS n, count_if(risk_level = 'High') AS h, string_agg({_ITEM}, chr(10) ORDER BY seq DESC, api_endpoint DESC) AS items FROM ({_VULNS}) GROUP BY js_url),
    s AS (SELECT js_url, count(*) AS n, count_if(risk_level = 'High') AS h, string_agg(sensitive_value || '|' || risk_level, chr(10) ORDER BY seq DESC, sensitive_value DESC) AS items FROM ({_SENSITIVE}) GROUP BY js_url)
    SELECT coalesce(v.js_url, s.js_url) AS js_url, v.items AS vuln_items, s.items AS sensitive_items, CAST(coalesce(v.n, 0) + coalesce(s.n, 0) AS BIGINT) AS total_findings, CAST(coalesce(v.h, 0) + coalesce(s.h, 0) AS BIGINT) AS total_high_risk FROM v FULL JOIN s ON v.js_url = s.js_url""",
)
def linked_report_items(spark, sf_dir):
    r = findings.linked_items(_vulns(spark, sf_dir), _sensitive(spark, sf_dir))
    lines = lambda items, name: F.array_join(F.transform(items, lambda x: F.concat(x[name], F.lit("|"), x["risk_level"])), "\n")
    return r.select("js_url", lines(F.col("ai_vulns.items"), "api_endpoint").alias("vuln_items"), lines(F.col("sensitive_info.items"), "sensitive_value").alias("sensitive_items"), "summary.total_findings", "summary.total_high_risk")


@query("vuln_by_endpoint", f"SELECT js_url, api_endpoint, risk_level FROM ({_VULNS}) WHERE api_endpoint = (SELECT min(api_endpoint) FROM ({_VULNS})) ORDER BY js_url LIMIT 1")
def vuln_by_endpoint(spark, sf_dir):
    v = _vulns(spark, sf_dir)
    endpoint = v.agg(F.min("api_endpoint")).first()[0]
    return findings.one_of_endpoint(v, endpoint).select("js_url", "api_endpoint", "risk_level")


_JS = "'https://js.example.com/' || (page_id % 40) || '.js'"
_MAP = "CASE WHEN page_id % 3 = 0 THEN 'Y' ELSE 'N' END"
_FLAGS = f"SELECT js_url, arg_max(flag, seq) AS is_source_map, max(seq) AS seq FROM (SELECT {_JS} AS js_url, {_MAP} AS flag, page_id AS seq FROM pages) GROUP BY js_url"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, F.lit("\n//# sourceMappingURL=a.js.map")).otherwise("")
    p = p.select(F.concat(F.lit("https://js.example.com/"), (F.col("page_id") % 40).cast("string"), F.lit(".js")).alias("url"), F.concat("html", tail).alias("html"), F.col("page_id").alias("seq"))
    return findings.source_maps(p, findings.source_maps(p.where("seq % 2 = 0")))


@query("source_map_upsert", _FLAGS)
def source_map_upsert(spark, sf_dir):
    return _flags(spark, sf_dir)


@query("source_map_exposure", f"SELECT CAST(count(*) AS BIGINT) AS scripts, CAST(count_if(is_source_map = 'Y') AS BIGINT) AS exposed FROM ({_FLAGS})")
def source_map_exposure(spark, sf_dir):
    return findings.exposure(_flags(spark, sf_dir))


@query("sensitive_json", """SELECT conv_id, '[' || string_agg('"' || role || '"', ',' ORDER BY turn) || ']' AS caller_codes, 'unknown' AS secret_type FROM conversations GROUP BY conv_id""")
def sensitive_json(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("caller_codes"))
    items = c.select("conv_id", F.lit("https://a.com/x.js").alias("js_url"), F.col("conv_id").cast("string").alias("sensitive_value"), "caller_codes", F.lit(None).cast("string").alias("secret_type"), F.col("conv_id").alias("seq"))
    return findings.sensitive_findings(items).select("conv_id", "caller_codes", "secret_type")


@query("code_compress")
def code_compress(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.compress(F.col("html")).alias("code"))


@query("judge_prompts")
def judge_prompts(spark, sf_dir):
    """Each page as a wrapper, whose callers are a conversation's turns."""
    callers = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("callers"))
    both = read(spark, sf_dir, "pages").join(callers, F.col("page_id") == F.col("conv_id"), "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))
    return both.select("page_id", params.judge_prompt(F.col("url"), F.col("html"), F.col("callers")).alias("judge"), params.advice_prompt(F.col("url"), F.col("html"), F.col("callers"), F.array(F.lit("id"))).alias("advice"))
