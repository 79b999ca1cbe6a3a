"""The crawl frontier over a closed corpus, fetch fallbacks and probes over recorded responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, urls
from ..shared import stored
from .dedup import unseen


def frontier(seeds: DataFrame, links: DataFrame, height: int = 2, node: str = "node", source: str = "source", target: str = "target") -> DataFrame:
    """node and depth of all that can be reached from seeds within height steps, each at its lowest depth.

    A round joins only the newest nodes with links and drops what is known; both are written to the shared folder, so
    lineage doesn't grow and no round is computed twice. Self-links and null nodes play no part.
    """
    level = stored(seeds.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("depth")), "level-0")
    known = level
    for depth in range(1, height + 1):
        reached = links.join(level.select(F.col("node").alias("__from")), F.col(source) == F.col("__from")).select(F.col(target).alias("node")).where("node IS NOT NULL").distinct()
        level = stored(reached.join(known.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")), f"level-{depth}")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.withColumnRenamed("node", node)


def with_fallback(pages: DataFrame, retried: DataFrame) -> DataFrame:
    """pages(url, status, source_code) with the failed ones (null source) replaced by a retry that succeeded, if there is one."""
    ok = retried.where("error IS NULL").groupBy("url").agg(F.min_by(F.struct("status_code", "response_content"), "seq").alias("r"))
    joined = pages.join(ok.withColumnRenamed("url", "__url"), F.col("url") == F.col("__url"), "left")
    use = F.col("source_code").isNull() & F.col("r").isNotNull()
    return joined.withColumns({"status": F.when(use, F.col("r.status_code")).otherwise(F.col("status")), "source_code": F.when(use, F.col("r.response_content")).otherwise(F.col("source_code"))}).drop("__url", "r")


def two_rounds(posted: DataFrame, got: DataFrame) -> DataFrame:
    """The POST answer of each URL, or where that was 405 the GET answer, if one is recorded."""
    again = posted.where("status_code = 405")
    second = got.join(again.select(F.col("url").alias("__url")).distinct(), F.col("url") == F.col("__url"), "left_semi")
    kept = again.join(second.select(F.col("url").alias("__url")).distinct(), F.col("url") == F.col("__url"), "left_anti")
    return posted.where("status_code IS NULL OR status_code <> 405").unionByName(kept).unionByName(second)


def probe_stats(posted: DataFrame, got: DataFrame) -> DataFrame:
    """Totals of a two-round probe. Posts that failed count as URLs and requests only; every 405 is a further request."""
    ok = F.col("error").isNull()
    refused = ok & F.col("status_code").eqNullSafe(405)
    first = posted.agg(F.count("*").alias("total_urls"), F.count_if(ok & ~refused).alias("post_only"), F.count_if(refused).alias("n405"), (F.count("*") + F.count_if(refused)).alias("total_requests"))
    again = posted.where(refused).select(F.col("url").alias("__url")).distinct()
    second = got.join(again, F.col("url") == F.col("__url"), "left_semi").agg(F.count("*").alias("post_then_get"))
    return first.crossJoin(second)  # one row by one row


def redirect_stats(fetched: DataFrame) -> DataFrame:
    """How fetched(status, redirect_count, html) ended: pages with html in all, successes by their redirects (0, 1, more), errors."""
    good = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False))
    times = F.coalesce("redirect_count", F.lit(0))
    return fetched.where(F.col("html") != "").agg(
        F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("error"),
        F.count_if(good & (times == 0)).alias("redirect_0"), F.count_if(good & (times == 1)).alias("redirect_1"), F.count_if(good & ~times.isin(0, 1)).alias("redirect_loop"),
    )


def fan_out(urls_: DataFrame, dynamic: DataFrame, static: DataFrame, url: str = "url", seed: str = "is_seed") -> DataFrame:
    """Recorded pages of a batch: those of dynamic URLs from one table, those of static ones from another; API paths are fetched from neither."""
    kind = urls_.select(F.col(url).alias("__url"), urls.classify(F.col(url), F.col(seed)).alias("__class")).distinct()

    def branch(table: DataFrame, name: str) -> DataFrame:
        wanted = kind.where(F.col("__class") == name)
        return table.join(wanted, F.col(url) == F.col("__url"), "left_semi").withColumn("fetched_as", F.lit(name))

    return branch(dynamic, "dynamic").unionByName(branch(static, "static"))


def secret_candidates(pages: DataFrame, seeds: list[str], url: str = "url", valid: str = "is_valid") -> DataFrame:
    """Pages to be searched for secrets: valid ones and seeds, if .js stands anywhere in the URL (so .json passes)."""
    return pages.where((F.col(valid).eqNullSafe(1) | F.col(url).isin(*seeds)) & F.contains(url, F.lit(".js")))


def pending(tasks: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Distinct tasks that aren't among the done ones; blanks fall away. Spaces around a line don't count."""
    line = F.trim(F.col(url)).alias(url)
    return unseen(tasks.select(line).where(F.col(url) != "").distinct(), done.select(line), url)


def admitted(pages: DataFrame, roots: list[str], url: str = "url", html: str = "html", status: str = "status") -> DataFrame:
    """Pages in scope, found, and of moderate size. Cheap conditions come first."""
    from ..functions.rules import MAX_PAGE_CHARS, MIN_PAGE_CHARS

    size = F.length(html)
    return pages.where(urls.in_scope(F.col(url), roots)).where(~F.col(status).eqNullSafe(404)).where((size >= MIN_PAGE_CHARS) & (size <= MAX_PAGE_CHARS))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html", leading: bool = False) -> DataFrame:
    """source_url, link as found and resolved target (null where it leads nowhere) of each distinct link of each page.

    With leading only links that lead somewhere: they come out of an explode, so no filter resolves them a second time.
    """
    parts = urls.base_parts(F.col(url)).alias("__parts")
    found = pages.select(F.col(url).alias("source_url"), parts, F.explode(extract.links(F.col(html))).alias("link"))
    way = urls.resolutions if leading else urls.resolve
    target = way(F.col("link"), F.col("source_url"), F.col("__parts"))
    return found.select("source_url", "link", (F.explode(target) if leading else target).alias("target"))


def api_sources(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Each admitted API path with the first page that names it, and how many do."""
    found = pages.select(F.col(url).alias("js_url"), F.explode(extract.links(F.col(html))).alias("api_path")).where(extract.is_api_path(F.col("api_path")))
    return found.groupBy("api_path").agg(F.min("js_url").alias("js_url"), F.count("*").alias("sources"))


def overflow(links: DataFrame, depth: int, height: int, roots: list[str]) -> DataFrame:
    """What remains to be scanned, by remaining depth: the children in scope, and siblings that are scripts."""
    child = F.col("is_child")
    keep = urls.in_scope(F.col("url"), roots) & (child | F.contains("url", F.lit(".js")))
    return links.where(keep).select("url", F.when(child, height - depth - 1).otherwise(height - depth).alias("remaining")).distinct()
