"""Links and API paths in page and script text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_QUERY = r"""(?:\?[^"|']*)?"""
_ABSOLUTE = r"""(?:[A-Za-z]{1,10}:)?//[^"'/]+\.[a-zA-Z]{2,}[^"']*"""
_ROOTED = r"""(?:\.{0,2}/)[^\\/ ^$%*\[\]()<>,;|"']+[^()<>,;|"']+"""
_NESTED = rf"""[\w/-]+/[\w/-]+\.(?:[a-zA-Z]{{1,4}}|action){_QUERY}"""
_FILE = rf"""[\w-]+\.(?:{"|".join(sorted("html action json jsp aspx asp php xml txt js".split(), reverse=True))}){_QUERY}"""
#: What stands between quotes, which may differ, and looks like a link. The same in Java's and RE2's syntax.
LINK = rf"""["']({_ABSOLUTE}|{_ROOTED}|{_NESTED}|{_FILE})["']"""
BLACKLISTED = r"(?:^|/)(?:del(?:ete)?(?:_[^/?]*)?|[^/?]*_del(?:ete)?)(?:\?[^/]*)?(?:/|$)"


def links(source: Column) -> Column:
    """The distinct links in a text, as an array; empty for a null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(source, F.lit(LINK), F.lit(1))), F.array().cast("array<string>"))


def is_blacklisted(path: Column) -> Column:
    """Whether a segment is, begins or ends with a word that deletes; true for null and empty."""
    return F.coalesce((path == "") | F.lower(path).rlike(BLACKLISTED), F.lit(True))


def is_api_path(text: Column) -> Column:
    """More than four characters, a slash, no dot, and not blacklisted."""
    return F.coalesce((F.length(text) > 4) & ~F.contains(text, F.lit(".")) & F.contains(text, F.lit("/")) & ~is_blacklisted(text), F.lit(False))


def is_candidate(path: Column) -> Column:
    """Whether a path is to be analysed further: four characters, not absolute, no static file, not blacklisted."""
    p = F.trim(path)
    return F.coalesce((F.length(p) >= 4) & ~p.rlike(r"^(?:http|//)") & ~rules.ends_with(F.lower(p), rules.NOT_API) & ~is_blacklisted(p), F.lit(False))


def has_source_map(source: Column) -> Column:
    """Y or N: whether the last 300 characters name a source map."""
    return F.when(F.contains(F.right(source, F.lit(300)), F.lit("sourceMappingURL=")), "Y").otherwise("N")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def may_repeat(url: Column, html: Column, title_: Column) -> Column:
    """Whether a page is compared by title: a document of moderate size without jquery, not a script, with a title of more than 7 characters."""
    t = F.trim(title_)
    return F.coalesce(
        ~F.contains(url, F.lit(".js")) & F.startswith(F.lower(html), F.lit("<!doctype html>")) & ~F.contains(F.lower(html), F.lit("jquery")) & (F.length(html) <= rules.MAX_DUPLICATE_CHARS) & (F.length(t) > 7),
        F.lit(False),
    )


def quick_verdict(url: Column, status: Column, snippet: Column) -> Column:
    """1 where a probe's answer is worth analysis; 0 for a refusal, a static file, a log-in or any page of markup."""
    from .urls import is_skipped

    s = F.lower(F.substring(F.coalesce(snippet, F.lit("")), 1, 600))
    answered = status.between(200, 300) | ((status >= 500) & (status < 600))
    return F.when((status == 401) | is_skipped(url), "0").when(answered & (rules.holds(s, rules.LOGIN_WORDS) | s.rlike("<!doctype|<html|<head")), "0").otherwise("1")
