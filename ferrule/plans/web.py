"""Queries over pages: links, URLs, admission, duplicates, the crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, rules, text, urls
from ..operators import bloom, crawl, dedup, findings
from ..sources import tables
from . import sqltext as S
from .common import Cases, q, query, read

ROOTS = ["example.com", "example.net"]
_LINKS = f"SELECT page_id, url, unnest({S.links('html')}) AS link FROM pages"
_USABLE, _TARGET = S.resolved("link", "url")
_ON_SITE = f"({S.root('out')}) = ({S.root('url')}) AND NOT {S.any_in('lower(' + S.path('out') + ')', rules.SKIPPED)}"
_EDGES = f"SELECT page_id, url, link, CASE WHEN {_ON_SITE} THEN out END AS target FROM (SELECT *, CASE WHEN {_USABLE} THEN {_TARGET} END AS out FROM ({_LINKS}))"
_SCOPED = "(" + " OR ".join(f"contains({S.netloc('url')}, {q(r)})" for r in ROOTS) + ")"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.link_edges(read(spark, sf_dir, "pages"))


@query("link_extract", f"SELECT page_id, link FROM ({_LINKS})")
def link_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(extract.links(F.col("html"))).alias("link"))


LINK_CASES = Cases(
    "id int, source string",
    [
        (1, "x = 'https://api.example.com/v1?a=b'"),
        (2, 'f("//cdn.example.com/x.js", "./rel/path", "../up/path", \'/root/path\')'),
        (3, 'a="static/app.js?v=1"; b="index.php"; c="main.html?x=1"; d="run/it.action"'),
        (4, 'e="no link"; f="a.b"; g="/"; h="word"; i="/a b"; j="mixed\''),
        (5, 'dup("/api/x"); dup("/api/x")'),
        (6, ""),
        (7, None),
    ],
)


#: What is a link in the cases, derived by hand from the rules.
LINKS_FOUND = Cases(
    "id int, link string",
    [
        (1, "https://api.example.com/v1?a=b"), (2, "//cdn.example.com/x.js"), (2, "./rel/path"), (2, "../up/path"), (2, "/root/path"),
        (3, "static/app.js?v=1"), (3, "index.php"), (3, "main.html?x=1"), (3, "run/it.action"), (4, "/a b"), (5, "/api/x"),
    ],
)


@query("link_extract_cases", f"SELECT id, link FROM {LINKS_FOUND.sql()}")
def link_extract_cases(spark, sf_dir):
    return LINK_CASES.frame(spark).select("id", F.explode(extract.links(F.col("source"))).alias("link"))


@query("link_resolve", f"SELECT url AS source_url, link, target FROM ({_EDGES})")
def link_resolve(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("link_edges_by_host", f"SELECT {S.netloc('url')} AS host, {S.classify('target')} AS url_class, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT target) AS BIGINT) AS targets FROM ({_EDGES}) WHERE target IS NOT NULL GROUP BY 1, 2")
def link_edges_by_host(spark, sf_dir):
    e = crawl.link_edges(read(spark, sf_dir, "pages"), leading=True)
    return e.groupBy(urls.netloc(F.col("source_url")).alias("host"), urls.classify(F.col("target")).alias("url_class")).agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"))


SEED = "https://www.example.com/app/"
#: Found text and what it means on SEED, derived by hand from the rules.
RESOLVED = [
    ("//api.example.com/v1/x", "https://api.example.com/v1/x"),
    ("/api/user/list", "https://www.example.com/api/user/list"),
    ("./v2/items", "https://www.example.com/app/v2/items"),
    ("../v2/items", "https://www.example.com/v2/items"),
    ("../../../v2/./a/../items?x=../y", "https://www.example.com/v2/items?x=../y"),
    ("https://other.org/x", None),
    ("api.example.com/v1", "https://api.example.com/v1"),
    ("api.example.com", "https://api.example.com/"),
    ("user/list/all", "https://www.example.com/app/user/list/all"),
    ("orders", "https://www.example.com/app?orders"),
    ("a/b/c", None),
    ("/a b/c/d", None),
    ("text/html", None),
    ("application/json", "https://www.example.com/app/application/json"),
    ("static/app.js", None),
    ("/static/app.js", "https://www.example.com/static/app.js"),
    ("/help/index.html", None),
    ("/img/.icons/list", None),
    ("/api//v1///x", "https://www.example.com/api/v1/x"),
    ("/go?u=http://a.example.com//x", "https://www.example.com/go?u=http://a.example.com/x"),
    ("\\api\\v1\\x", "https://www.example.com/api/v1/x"),
    ("javascript:void(0)", None),
    ("config/x.js", None),
]
RESOLVE_CASES = Cases("link string, expected string", RESOLVED)


@query("link_resolve_cases", f"SELECT link, expected AS target FROM {RESOLVE_CASES.sql()}")
def link_resolve_cases(spark, sf_dir):
    return RESOLVE_CASES.frame(spark).select("link", urls.resolve(F.col("link"), F.lit(SEED)).alias("target"))


CLASSES = Cases(
    "url string, seed boolean, expected string",
    [(u, False, c) for u, c in [("https://a.com/api/list", "api"), ("https://a.com", "api"), ("https://a.com/app.js?v=1", "static"), ("https://a.com/x.html", "static"), ("https://a.com/x.xhtml", "dynamic"), ("https://a.com/x.php", "dynamic"), ("https://a.com/v1.0/list", "dynamic"), ("https://a.com/app.js#x", "dynamic")]] + [("https://a.com/app.js", True, "dynamic")],
)


@query("url_classify_cases", f"SELECT url, expected AS url_class FROM {CLASSES.sql()}")
def url_classify_cases(spark, sf_dir):
    return CLASSES.frame(spark).select("url", urls.classify(F.col("url"), F.col("seed")).alias("url_class"))


@query(
    "url_classify",
    f"""SELECT page_id, url, {S.classify('url')} AS url_class, {S.ends(S.lower_cut('url'), rules.PLAIN)} AS is_static,
    {S.ends(S.lower_cut('url'), ('.htm', '.html', '.xhtml'))} AS is_html, {S.ends(S.lower_cut('url'), rules.SKIPPED)} AS is_skipped FROM pages""",
)
def url_classify(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", "url", urls.classify(u).alias("url_class"), urls.is_static(u).alias("is_static"), urls.is_html(u).alias("is_html"), urls.is_skipped(u).alias("is_skipped"))


@query("url_parts", f"SELECT page_id, {S.scheme('url')} AS scheme, {S.netloc('url')} AS netloc, {S.path('url')} AS path, {S.host('url')} AS host, CAST(CASE WHEN {S.scheme('url')} = 'https' THEN 443 ELSE 80 END AS INTEGER) AS port, {S.root('url')} AS root FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.host(u).alias("host"), urls.port(u).alias("port"), urls.root_domain(u).alias("root"))


ROOT_CASES = Cases(
    "url string, expected string",
    [("https://www.example.com/x", "example.com"), ("http://a.b.example.co.uk:8080/", "example.co.uk"), ("https://user:pw@shop.example.com.cn/", "example.com.cn"), ("http://10.0.0.1:80/", "10.0.0.1:80"), ("http://localhost/x", "localhost"), ("nonsense", "")],
)


@query("url_root_cases", f"SELECT url, expected AS root FROM {ROOT_CASES.sql()}")
def url_root_cases(spark, sf_dir):
    return ROOT_CASES.frame(spark).select("url", urls.root_domain(F.col("url")).alias("root"))


SCRIPT_CASES = Cases(
    "url string, script boolean, domain boolean, slash boolean",
    [("/a.js", True, True, True), ("/a.js?x", True, True, True), ("/a.json", False, True, True), ("/a.jsx", False, True, True), ("www.example.com/a", False, True, True), ("1.2.3", False, False, False), (".x.com", False, False, False), ("a.com.", False, False, False), ("//", False, False, False), ("v1.c", False, False, False)],
)


@query("url_tests_cases", f"SELECT url, script, domain, slash FROM {SCRIPT_CASES.sql()}")
def url_tests_cases(spark, sf_dir):
    u = F.col("url")
    return SCRIPT_CASES.frame(spark).select("url", urls.is_script(u).alias("script"), urls.is_potential_domain(u).alias("domain"), u.rlike(urls.JOINED_SLASH).alias("slash"))


@query("url_scope_filter", f"SELECT page_id, url FROM pages WHERE {_SCOPED}")
def url_scope_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(urls.in_scope(F.col("url"), ROOTS)).select("page_id", "url")


@query("scope_theta_semi", f"WITH roots AS (SELECT unnest([{', '.join(map(q, ROOTS))}]) AS root) SELECT page_id, url FROM pages WHERE EXISTS (SELECT 1 FROM roots WHERE contains({S.netloc('url')}, root))")
def scope_theta_semi(spark, sf_dir):
    roots = tables.scope(spark.createDataFrame([(r,) for r in ["", *ROOTS]], "root string"), ROOTS[0])
    every = roots.agg(F.collect_set("root").alias("roots"))  # one row: a scope is a short list
    return read(spark, sf_dir, "pages").join(F.broadcast(every)).where(urls.in_scope(F.col("url"), F.col("roots"))).select("page_id", "url")


@query(
    "url_should_scan",
    f"""SELECT page_id, url FROM pages WHERE {_SCOPED} AND ({S.ends(S.lower_cut('url'), rules.SCRIPT_OR_PAGE)} OR NOT contains(regexp_extract({S.lower_cut('url')}, '([^/]*)$', 1), '.'))
    AND url NOT IN (SELECT url FROM pages WHERE contains(url, '?'))""",
)
def url_should_scan(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    visited = pages.where(F.contains("url", F.lit("?"))).select("url")
    return dedup.unseen(pages.where(urls.in_scope(F.col("url"), ROOTS) & urls.is_scannable(F.col("url"))).select("page_id", "url"), visited, "url")


SCAN_CASES = Cases(
    "url string, expected boolean",
    [("https://example.com", False), ("https://example.com/", True), ("https://example.com/a.js?x=1", True), ("https://example.com/a.css", False), ("https://example.com/v1.0/list", True), ("https://example.com/api/list#a.b", False), ("https://notexample.com/", True), ("https://example.org/", False), ("", False)],
)


@query("url_should_scan_cases", f"SELECT url, expected AS scanned FROM {SCAN_CASES.sql()}")
def url_should_scan_cases(spark, sf_dir):
    u = F.col("url")
    return SCAN_CASES.frame(spark).select("url", (urls.in_scope(u, ["example.com"]) & urls.is_scannable(u)).alias("scanned"))


@query("visited_anti_join", f"SELECT DISTINCT target AS url FROM ({_EDGES}) WHERE target IS NOT NULL AND target NOT IN (SELECT target FROM ({_EDGES}) WHERE target IS NOT NULL AND page_id % 3 = 0)")
def visited_anti_join(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"), F.explode(extract.links(F.col("html"))).alias("link"))
    found = found.select("page_id", urls.resolve(F.col("link"), F.col("source_url")).alias("url")).where("url IS NOT NULL")
    return dedup.new_keys(found, found.where("page_id % 3 = 0").select("url"), "url")


@query("visited_bloom", f"SELECT DISTINCT target AS url FROM ({_EDGES}) WHERE target IS NOT NULL AND target NOT IN (SELECT target FROM ({_EDGES}) WHERE target IS NOT NULL AND page_id % 3 = 0)")
def visited_bloom(spark, sf_dir):
    """visited_anti_join, but what the state's Bloom filter lacks takes no part in the join."""
    found = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"), F.explode(extract.links(F.col("html"))).alias("link"))
    found = found.select("page_id", urls.resolve(F.col("link"), F.col("source_url")).alias("url")).where("url IS NOT NULL")
    return bloom.unseen(found.select("url").distinct(), found.where("page_id % 3 = 0").select("url"), "url", capacity=1_000_000)


@query("pending_tasks", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def pending_tasks(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return crawl.pending(p.select(F.concat(F.lit(" "), "url").alias("url")), p.where("page_id % 4 = 0").select("url"))


@query("secret_candidates", "SELECT page_id, url FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '' END AS url, page_id % 3 AS is_valid FROM pages) WHERE is_valid = 1 AND contains(url, '.js')")
def secret_candidates(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, ".json").otherwise("")).alias("url"), (F.col("page_id") % 3).alias("is_valid"))
    return crawl.secret_candidates(p, ["https://seed.example.org/a.js"]).select("page_id", "url")


@query("fan_out", f"SELECT page_id, {S.classify('url')} AS fetched_as FROM pages WHERE {S.classify('url')} <> 'api'")
def fan_out(spark, sf_dir):
    """Recorded pages of either fetcher stand in two tables; each URL's comes from that of its class."""
    p = read(spark, sf_dir, "pages")
    return crawl.fan_out(p.select("url", F.lit(False).alias("is_seed")), p, p).select("page_id", "fetched_as")


ALLOWED_CASES = Cases(
    "link string, expected string",
    [("https://other.org/x", "https://other.org/x"), ("//cdn.other.org/y", "https://cdn.other.org/y"), ("https://third.org/x", None), ("https://other.org/x.png", None), ("/api/user/list", "https://www.example.com/api/user/list")],
)


@query("link_resolve_allowed_cases", f"SELECT link, expected AS target FROM {ALLOWED_CASES.sql()}")
def link_resolve_allowed_cases(spark, sf_dir):
    return ALLOWED_CASES.frame(spark).select("link", urls.resolve(F.col("link"), F.lit(SEED), None, ["other.org"]).alias("target"))


@query("api_path_admission", f"SELECT page_id, link FROM ({_LINKS}) WHERE {S.api_path('link')}")
def api_path_admission(spark, sf_dir):
    return link_extract(spark, sf_dir).where(extract.is_api_path(F.col("link")))


PATH_CASES = Cases(
    "path string, blacklisted boolean, admitted boolean",
    [("/user/delete", True, False), ("/delete_user", True, False), ("/user_del", True, False), ("/a/del?id=1", True, False), ("/DELETE/x", True, False), ("", True, False), (None, True, False), ("/deleted", False, True), ("/undelete", False, True), ("/model", False, True), ("/api/v1", False, True), ("/api", False, False), ("/api/v1.0", False, False), ("login", False, False), ("/user/del", True, False)],
)


@query("api_path_blacklist", f"SELECT path, blacklisted, admitted FROM {PATH_CASES.sql()} UNION ALL SELECT link, {S.blacklisted('link')}, {S.api_path('link')} FROM ({_LINKS})")
def api_path_blacklist(spark, sf_dir):
    rows = PATH_CASES.frame(spark).select("path").unionByName(link_extract(spark, sf_dir).select(F.col("link").alias("path")))
    p = F.col("path")
    return rows.select("path", extract.is_blacklisted(p).alias("blacklisted"), extract.is_api_path(p).alias("admitted"))


@query("api_path_blacklist_cases", f"SELECT path, blacklisted, admitted FROM {PATH_CASES.sql()}")
def api_path_blacklist_cases(spark, sf_dir):
    p = F.col("path")
    return PATH_CASES.frame(spark).select("path", extract.is_blacklisted(p).alias("blacklisted"), extract.is_api_path(p).alias("admitted"))


@query("api_first_source", f"SELECT link AS api_path, min(url) AS js_url, CAST(count(*) AS BIGINT) AS sources FROM ({_LINKS}) WHERE {S.api_path('link')} GROUP BY link")
def api_first_source(spark, sf_dir):
    return crawl.api_sources(read(spark, sf_dir, "pages"))


@query("page_admission", f"SELECT page_id, url FROM (SELECT *, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status FROM pages) WHERE {_SCOPED} AND status <> 404 AND length(html) BETWEEN {rules.MIN_PAGE_CHARS} AND {rules.MAX_PAGE_CHARS}")
def page_admission(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").withColumn("status", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200))
    return crawl.admitted(pages, ROOTS).select("page_id", "url")


_TITLE = f"lower(trim({S.title('html')}))"
_COMPARED = f"(NOT contains(url, '.js') AND starts_with(lower(html), '<!doctype html>') AND NOT contains(lower(html), 'jquery') AND length(html) <= {rules.MAX_DUPLICATE_CHARS} AND length({_TITLE}) > 7)"


@query("page_title_dedup", f"SELECT page_id, url FROM pages WHERE NOT {_COMPARED} OR page_id IN (SELECT min(page_id) FROM pages WHERE {_COMPARED} GROUP BY {S.netloc('url')}, {_TITLE})")
def page_title_dedup(spark, sf_dir):
    return dedup.distinct_titles(read(spark, sf_dir, "pages")).select("page_id", "url")


@query("source_map_flag", "SELECT page_id AS id, CASE WHEN contains(right(html, 300), 'sourceMappingURL=') THEN 'Y' ELSE 'N' END AS is_source_map FROM pages UNION ALL SELECT -1, 'Y' UNION ALL SELECT -2, 'N'")
def source_map_flag(spark, sf_dir):
    extra = spark.createDataFrame([(-1, "f()\n//# sourceMappingURL=maps/app.js.map"), (-2, "//# sourceMappingURL=a.js.map" + " " * 300)], "id bigint, html string")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html").unionByName(extra).select("id", extract.has_source_map(F.col("html")).alias("is_source_map"))


@query("strip_tags_summary", f"SELECT page_id, substring({S.strip_tags('html')}, 1, 500) AS summary FROM pages")
def strip_tags_summary(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.summary(F.col("html")).alias("summary"))


@query(
    "edge_insert_first",
    f"""SELECT url, {S.netloc('url')} AS domain, {S.path('url')} AS path, arg_min(source_url, (scan_depth, source_url)) AS source_url, min(scan_depth) AS scan_depth
    FROM (SELECT trim(link) AS url, url AS source_url, CAST(page_id % 4 AS INTEGER) AS scan_depth FROM ({_LINKS})) WHERE url <> '' AND NOT {S.ends(S.lower_cut('url'), rules.UNRECORDED)}
    AND url NOT IN (SELECT trim(link) FROM ({_LINKS}) WHERE page_id < 5) GROUP BY url""",
)
def edge_insert_first(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    found = pages.select(F.col("url").alias("source_url"), extract.links(F.col("html")).alias("next_urls"), (F.col("page_id") % 4).cast("int").alias("scan_depth"))
    known = pages.where("page_id < 5").select(F.explode(extract.links(F.col("html"))).alias("url")).select(F.trim("url").alias("url"))
    return findings.edges(found, known)


@query("crawl_frontier_depth")
def crawl_frontier_depth(spark, sf_dir):
    """A closed corpus: each customer leads to two others of the whole table, and each hundredth is a seed, so the frontier grows with it."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"))
    n = c.count()
    edges = c.withColumn("target", (F.col("source") * 7 + 3) % n + 1).unionByName(c.withColumn("target", (F.col("source") * 13 + 5) % n + 1))
    return crawl.frontier(c.where("source % 100 = 1").select(F.col("source").alias("node")), edges, height=5)


#: A small closed corpus: each customer leads to two of the first ones.
_GRAPH = "SELECT c_custkey AS source, (c_custkey * 7 + 3) % 1009 AS target FROM customer UNION ALL SELECT c_custkey, (c_custkey * 13 + 5) % 997 FROM customer"


@query(
    "crawl_frontier_small",
    f"""WITH RECURSIVE edges AS ({_GRAPH}), reached AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT target, depth + 1 FROM reached JOIN edges ON source = node WHERE depth < 5)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM reached GROUP BY node""",
)
def crawl_frontier_small(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"))
    edges = c.withColumn("target", (F.col("source") * 7 + 3) % 1009).unionByName(c.withColumn("target", (F.col("source") * 13 + 5) % 997))
    return crawl.frontier(spark.createDataFrame([(1,)], "node bigint"), edges, height=5)


@query(
    "overflow_queue",
    f"SELECT DISTINCT url, CAST(CASE WHEN is_child THEN 2 ELSE 3 END AS INTEGER) AS remaining FROM (SELECT target AS url, page_id % 2 = 0 AS is_child FROM ({_EDGES}) WHERE target IS NOT NULL) WHERE {_SCOPED} AND (is_child OR contains(url, '.js'))",
)
def overflow_queue(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 2 == 0).alias("is_child"), F.col("url").alias("base"), F.explode(extract.links(F.col("html"))).alias("link"))
    return crawl.overflow(p.select("is_child", urls.resolve(F.col("link"), F.col("base")).alias("url")).where("url IS NOT NULL"), 0, 3, ROOTS)


@query("batch_ids", "SELECT url, CAST((row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY url, page_id) - 1) // 200 AS INTEGER) AS batch FROM pages")
def batch_ids(spark, sf_dir):
    """Batches of 200 of each host's URLs; within a host, so that no single task numbers all rows."""
    from pyspark.sql import Window

    order = Window.partitionBy(urls.netloc(F.col("url"))).orderBy("url", "page_id")
    return read(spark, sf_dir, "pages").select("url", F.floor((F.row_number().over(order) - 1) / 200).cast("int").alias("batch"))


URL_LINES = Cases("line string", [("https://b.example.com/",), ("  https://a.example.com/   x ",), ("# note",), ("",), ("   ",), ("https://b.example.com/",)])


@query("url_list", r"SELECT DISTINCT url FROM (SELECT trim(regexp_replace(line, '\s+', ' ', 'g')) AS url FROM " + URL_LINES.sql() + ") WHERE url <> '' AND NOT starts_with(url, '#')")
def url_list(spark, sf_dir):
    return tables.url_list(URL_LINES.frame(spark))
