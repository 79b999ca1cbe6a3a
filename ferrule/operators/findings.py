"""Tables of findings: edges, API findings, sensitive values; upserts, updates, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, params, rules, urls
from .dedup import keep_first, keep_last, unseen


def edges(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """url, domain, path, source_url and scan_depth of each URL in found(source_url, next_urls, scan_depth), by its first discoverer.

    First is the lowest depth, then the lowest source. Static files, blanks and URLs of existing are left out.
    """
    rows = found.select(F.trim("source_url").alias("source_url"), "scan_depth", F.explode("next_urls").alias("url")).withColumn("url", F.trim("url"))
    rows = keep_first(rows.where((F.col("url") != "") & ~urls.is_unrecorded(F.col("url"))), ["url"], ["scan_depth", "source_url"])
    out = rows.select("url", urls.netloc(F.col("url")).alias("domain"), urls.path(F.col("url")).alias("path"), "source_url", "scan_depth")
    return out if existing is None else unseen(out, existing, "url")


def api_findings(advice: DataFrame) -> DataFrame:
    """advice(js_url, api_endpoint, method, path, params, seq) as findings: normalised, scored, the last of a key kept."""
    last = keep_last(advice, ["js_url", "api_endpoint"], ["seq"])
    parsed = params.stored(F.col("params"))
    method = params.stored_method(F.col("method"))
    return last.select("js_url", "api_endpoint", method.alias("http_method"), params.risk(F.col("path"), method, parsed).alias("risk_level"), "path", parsed.alias("params"), F.lit(None).cast("string").alias("request_status"), F.lit(None).cast("int").alias("response_code"), F.lit(None).cast("int").alias("response_length"), F.lit(None).cast("string").alias("response_body_preview"), "seq")


def sensitive_findings(items: DataFrame) -> DataFrame:
    """items with a script and a value, the last for each of both. Arrays and maps are stored as JSON; a missing risk is Low, a missing type unknown."""
    kept = keep_last(items.where(rules.nonblank(F.col("js_url")) & (F.col("sensitive_value") != "")), ["js_url", "sensitive_value"], ["seq"])
    changed = {c: F.to_json(c) for c, kind in kept.dtypes if kind.startswith(("array", "map", "struct"))}
    changed |= {c: F.coalesce(c, F.lit(default)) for c, default in (("risk_level", "Low"), ("secret_type", "unknown")) if c in kept.columns}
    return kept.withColumns(changed) if changed else kept


def source_maps(pages: DataFrame, existing: DataFrame | None = None, url: str = "url", html: str = "html", order: str = "seq") -> DataFrame:
    """js_url, is_source_map and order of each script: whether it names a source map, the last for each script, after those of existing."""
    new = pages.select(F.col(url).alias("js_url"), extract.has_source_map(F.col(html)).alias("is_source_map"), order)
    return keep_last(new, ["js_url"], [order]) if existing is None else upsert(existing, new, ["js_url"], order)


def exposure(flags: DataFrame) -> DataFrame:
    """Scripts looked at, and those that expose a source map."""
    return flags.agg(F.count("*").alias("scripts"), F.count_if(F.col("is_source_map") == "Y").alias("exposed"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """table with new's rows; of rows of one key the last in order, new ones after old ones of equal order."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [order, "__new"]).drop("__new")


def apply_replays(findings: DataFrame, replays: DataFrame, key: str = "id") -> DataFrame:
    """findings with the outcome of replays(id, status_code, content_summary); the length is the summary's, as stored."""
    r = keep_last(replays, [key], ["status_code", "content_summary"]).select(F.col(key).alias("__id"), "status_code", "content_summary")
    hit = F.col("__id").isNotNull()
    return findings.join(r, F.col(key) == F.col("__id"), "left").withColumns(
        {
            "request_status": F.when(hit, F.when(F.col("status_code") > 0, "success").otherwise("failed")).otherwise(F.col("request_status")),
            "response_code": F.when(hit, F.col("status_code")).otherwise(F.col("response_code")),
            "response_length": F.when(hit, F.length(F.coalesce("content_summary", F.lit("")))).otherwise(F.col("response_length")),
            "response_body_preview": F.when(hit, F.col("content_summary")).otherwise(F.col("response_body_preview")),
        }
    ).drop("__id", "status_code", "content_summary")


def stats(api: DataFrame, sensitive: DataFrame, scanned: DataFrame, visited: DataFrame) -> DataFrame:
    """section, metric, value and n: totals, and counts by risk and type. Each table is read once."""

    def grouped(df: DataFrame, section: str, columns: dict[str, str]) -> DataFrame:
        sets = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for m, c in columns.items()]
        rows = df.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.lit(None).cast("string").alias("value")), *sets)).alias("g")).groupBy("g.metric", "g.value").agg(F.count("*").alias("n"))
        return rows.select(F.lit(section).alias("section"), "metric", "value", "n")

    parts = [grouped(api, "ai_vulns", {"by_risk": "risk_level"}), grouped(sensitive, "sensitive_info", {"by_risk": "risk_level", "by_type": "secret_type"}), grouped(scanned, "scan_results", {}), grouped(visited, "visited_urls", {})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linked_report(api: DataFrame, sensitive: DataFrame) -> DataFrame:
    """For each script the numbers of its API and sensitive findings, high ones apart."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("js_url").agg(F.count("*").alias(f"{name}_count"), F.count_if(F.col("risk_level") == "High").alias(f"high_{name}_count"))

    both = side(api, "vuln").join(side(sensitive, "sensitive"), "js_url", "full_outer")
    return both.na.fill(0)


def linked_items(api: DataFrame, sensitive: DataFrame, order: str = "seq") -> DataFrame:
    """For each script its API and sensitive findings with their totals, newest first, and a summary of both.

    A script's findings are one row, as a report shows them; findings of a script are few, however many scripts there are.
    """

    def side(df: DataFrame, name: str, tie: str) -> DataFrame:
        rest = [c for c in df.columns if c != "js_url"]

        def newer(a: Column, b: Column) -> Column:
            first = F.struct(a[order].alias("o"), a[tie].alias("t")), F.struct(b[order].alias("o"), b[tie].alias("t"))
            return F.when(first[0] > first[1], -1).when(first[0] < first[1], 1).otherwise(0)

        items = F.array_sort(F.collect_list(F.struct(*rest)), newer)
        return df.groupBy(F.col("js_url").alias(f"__{name}")).agg(F.struct(F.count("*").alias("total"), F.count_if(F.col("risk_level") == "High").alias("high_risk"), items.alias("items")).alias(name))

    both = side(api, "ai_vulns", "api_endpoint").join(side(sensitive, "sensitive_info", "sensitive_value"), F.col("__ai_vulns") == F.col("__sensitive_info"), "full_outer")
    count = lambda field: F.coalesce(F.col(f"ai_vulns.{field}"), F.lit(0)) + F.coalesce(F.col(f"sensitive_info.{field}"), F.lit(0))
    summary = F.struct(count("total").alias("total_findings"), count("high_risk").alias("total_high_risk"))
    return both.select(F.coalesce("__ai_vulns", "__sensitive_info").alias("js_url"), "ai_vulns", "sensitive_info", summary.alias("summary"))


def one_of_endpoint(findings: DataFrame, endpoint: str) -> DataFrame:
    """The first finding of an endpoint by script, none or one."""
    return findings.where(F.col("api_endpoint") == endpoint).orderBy("js_url").limit(1)


def decoded(findings: DataFrame, columns: list[str]) -> DataFrame:
    """findings with stored JSON read as variants; what is no JSON stays a text."""
    return findings.withColumns({c: params.json_or_text(F.col(c)) for c in columns})


def where(findings: DataFrame, column: str | None = None, value: str | None = None, order: str = "created_at") -> DataFrame:
    """Findings, of one value of a column if it is given, the newest first, with id for equal times."""
    chosen = findings if column is None else findings.where(F.col(column) == value)
    return chosen.orderBy(F.desc(order), F.desc("id"))


def csv_lines(findings: DataFrame) -> DataFrame:
    """A line for each High finding, quoted throughout; header() comes before them."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    flat = F.replace(F.replace(F.col("path"), F.lit(","), F.lit(";")), F.lit("\n"), F.lit(" "))
    columns: list[Column] = [F.col("api_endpoint"), F.col("http_method"), F.col("risk_level"), flat, params.to_csv(F.col("params"))]
    return findings.where("risk_level = 'High'").select(F.concat_ws(",", *[quoted(c) for c in columns]).alias("line"))


def header() -> str:
    return ",".join(["URL", "Method", "Risk Level", "Path", "Params"])
