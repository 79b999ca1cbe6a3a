"""The parameter audit of API paths: candidates, context, recorded verdicts and advice, findings.

Model answers are input tables, joined by API path; the engine itself calls no model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, params, urls
from ..functions.jscontext import api_contexts
from ..shared import ship
from .dedup import keep_first, unseen


def candidates(paths: DataFrame, processed: DataFrame, qualified: DataFrame | None = None) -> DataFrame:
    """paths(api_path, js_url) that are to be analysed, each with its first script; without those already processed.

    With a non-empty qualified(api_path), only paths in it; an empty one lets all pass. State is taken off before
    anything is parsed.
    """
    fit = paths.withColumn("api_path", F.trim("api_path")).where(extract.is_candidate(F.col("api_path")))
    if qualified is not None and not qualified.isEmpty():
        fit = fit.join(qualified.select(F.col("api_path").alias("__ok")), F.col("api_path") == F.col("__ok"), "left_semi")
    return unseen(keep_first(fit.select("api_path", "js_url"), ["api_path"], ["js_url"]), processed, "api_path")


def by_script(paths: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each script with its paths in order, as api_contexts takes them. Paths of pages that are no scripts fall away."""
    grouped = paths.groupBy("js_url").agg(F.sort_array(F.collect_set("api_path")).alias("api_paths"))
    return scripts.join(grouped, "js_url")


def contexts(paths: DataFrame, scripts: DataFrame) -> DataFrame:
    ship(scripts.sparkSession)
    return api_contexts(by_script(paths, scripts))


def needs_verdict(found: DataFrame) -> DataFrame:
    """Contexts that were found and show code, callers or a query."""
    return found.where(F.col("found") & ((F.col("wrapper_code") != "") | (F.size("caller_codes") > 0) | F.contains("api_path", F.lit("?"))))


def judged(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Contexts whose verdict in answers(api_path, answer) is that there are parameters. One without an answer is left out."""
    v = keep_first(answers, ["api_path"], ["answer"]).select(F.col("api_path").alias("__path"), params.verdict(F.col("answer")).alias("verdict"))
    return found.join(v, F.col("api_path") == F.col("__path")).where("verdict.has_value <> 0").drop("__path")


def advised(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Contexts with the advice that can be read in answers(api_path, answer), as findings.api_findings takes them."""
    a = keep_first(answers, ["api_path"], ["answer"]).select(F.col("api_path").alias("__path"), params.advisory(F.col("answer"), F.col("api_path")).alias("a"))
    rows = found.join(a, F.col("api_path") == F.col("__path")).where("a IS NOT NULL")
    target = F.coalesce(urls.resolve(F.col("api_path"), F.col("js_url")), urls.prefixed(F.col("api_path"), F.col("js_url")))
    return rows.select("js_url", target.alias("api_endpoint"), "a.method", "a.path", "a.params", F.xxhash64("js_url", "api_path").alias("seq"))


def probed(paths: DataFrame, probes: DataFrame, base: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """paths(api_path, js_url) with full_url, their place on base (by default their own script), and its answer in probes.

    A path that means no URL is put behind the script's scheme and host. Paths of fewer than four characters and
    blacklisted ones are left out, and so is what was not probed. probes(url, status_code, response_content) has each URL once.
    """
    p = paths.withColumns({"api_path": F.trim("api_path"), "js_url": F.trim("js_url")})
    p = p.where((F.length("api_path") >= 4) & ~extract.is_blacklisted(F.col("api_path")) & (F.col("js_url") != ""))
    on = F.col("js_url") if base is None else F.lit(base)
    full = F.trim(F.coalesce(urls.resolve(F.col("api_path"), on, None, allowed), urls.prefixed(F.col("api_path"), F.col("js_url"))))
    answers = probes.select(F.trim("url").alias("__url"), "status_code", "response_content")
    return p.withColumn("full_url", full).join(answers, F.col("full_url") == F.col("__url")).drop("__url")


def qualified(answered: DataFrame) -> DataFrame:
    """The distinct api_path of probed() whose answer is worth analysis: what candidates() takes as qualified."""
    return answered.where(extract.quick_verdict(F.col("full_url"), F.col("status_code"), F.substring("response_content", 1, 600)) == "1").select("api_path").distinct()


def funnel(judged_: DataFrame, advice: DataFrame) -> DataFrame:
    """Paths that came to the last step, and those of them with advice that can be read."""
    ok = advice.select(F.col("api_path").alias("__path")).distinct()
    return judged_.select("api_path").distinct().join(ok, F.col("api_path") == F.col("__path"), "left").agg(F.count("*").alias("total"), F.count("__path").alias("success"))


GRAM = 4


def containing(literals: DataFrame, paths: DataFrame, literal: str = "literal", path: str = "api_path", rank: str = "rank") -> DataFrame:
    """Each literal with the path of lowest rank that it contains.

    A containment join has no key of its own, so it gets one: of the grams of a path that which fewest literals have
    (any literal that contains the path has it too). A gram has GRAM characters; a shorter path is a gram itself.
    Literals are looked at by their grams of just the lengths that paths have, and only by those that some path has.
    """

    def grams(text: Column, sizes: Column) -> Column:
        each = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n))
        return F.array_distinct(F.flatten(F.transform(sizes, each)))

    p = paths.where(F.length(path) > 0).select(F.col(path).alias("__path"), F.col(rank).alias("__rank"))
    own = p.select("__path", F.explode(grams(F.col("__path"), F.array(F.least(F.length("__path"), F.lit(GRAM))))).alias("__gram"))
    sizes = own.agg(F.collect_set(F.length("__gram")).alias("__sizes"))  # at most GRAM numbers
    found = literals.where(F.length(literal) > 0).select(literal).distinct().join(F.broadcast(sizes)).select(literal, F.explode(grams(F.col(literal), F.col("__sizes"))).alias("__gram"))
    found = found.join(own.select(F.col("__gram").alias("__of")).distinct(), F.col("__gram") == F.col("__of"), "left_semi")
    rare = own.join(found.groupBy(F.col("__gram").alias("__of")).agg(F.count("*").alias("__n")), F.col("__gram") == F.col("__of"), "left")
    key = rare.groupBy("__path").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__gram"), F.min(F.coalesce("__n", F.lit(0))).alias("__n"))
    hits = found.join(p.join(key.where("__n > 0"), "__path"), "__gram").where(F.contains(literal, "__path"))
    return hits.groupBy(literal).agg(F.min_by("__path", "__rank").alias(path))
