"""The functions' meaning once more as DuckDB SQL, for the queries' oracles."""

from __future__ import annotations

from ..functions import detect, extract, rules, text, urls
from .common import q


def lower_cut(u: str) -> str:
    return f"split_part(lower({u}), '?', 1)"


def ends(u: str, endings: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with({u}, {q(e)})" for e in endings) + ")"


def any_in(t: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def one_of(x: str, words: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(map(q, words))})"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, {q(urls._NETLOC)}, 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, {q(urls._PATH)}, 1)"


def scheme(u: str) -> str:
    return f"split_part({u}, ':', 1)"


def host(u: str) -> str:
    return f"lower(split_part({netloc(u)}, ':', 1))"


def root(u: str) -> str:
    return f"CASE WHEN regexp_extract({host(u)}, {q(urls._ROOT)}, 1) = '' THEN {netloc(u)} ELSE regexp_extract({host(u)}, {q(urls._ROOT)}, 1) END"


def classify(u: str) -> str:
    return f"CASE WHEN NOT contains({path(u)}, '.') THEN 'api' WHEN {ends(lower_cut(u), rules.PLAIN)} THEN 'static' ELSE 'dynamic' END"


def links(t: str) -> str:
    return f"list_distinct(regexp_extract_all({t}, {q(extract.LINK)}, 1))"


def blacklisted(p: str) -> str:
    return f"coalesce({p} = '' OR regexp_matches(lower({p}), {q(extract.BLACKLISTED)}), true)"


def api_path(t: str) -> str:
    return f"(length({t}) > 4 AND NOT contains({t}, '.') AND contains({t}, '/') AND NOT {blacklisted(t)})"


def title(h: str) -> str:
    return f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"


def strip_tags(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({t}, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


def chain(t: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, by in steps:
        t = f"regexp_replace({t}, {q(pattern)}, {q(by)}, 'g')"
    return t


def normalized(t: str) -> str:
    empty = q('')
    return rf"regexp_replace({chain(f'coalesce({t}, {empty})', text.VOLATILE)}, '\s+', '', 'g')"


def risk(t: str) -> str:
    return f"CASE WHEN {any_in(f'lower({t})', rules.HIGH_RISK)} THEN 'High' WHEN {any_in(f'lower({t})', rules.MEDIUM_RISK)} THEN 'Med' ELSE 'Low' END"


def potential_domain(u: str) -> str:
    return rf"(regexp_matches({u}, '^[^.]*\p{{L}}[^.]*\.[^/]*\p{{L}}') AND regexp_matches({u}, '^[^.]*\.[^/]{{2,}}') AND NOT ends_with({u}, '.'))"


def resolved(found: str, base: str) -> tuple[str, str]:
    """All cases but paths with dots, which the tables don't hold; those are tested against hand-derived cases."""
    u = f"trim(replace({found}, chr(92), '/'))"
    at = f"{scheme(base)} || '://' || {netloc(base)}"
    own = f"rtrim({path(base)}, '/')"
    out = f"""CASE WHEN starts_with({u}, '//') THEN {scheme(base)} || ':' || {u}
      WHEN starts_with({u}, '/') THEN {at} || {u}
      WHEN regexp_matches({u}, '^https?://') THEN {u}
      WHEN {potential_domain(u)} THEN {scheme(base)} || '://' || {u} || CASE WHEN contains({u}, '/') THEN '' ELSE '/' END
      WHEN contains({u}, '/') THEN {at} || {own} || '/' || ltrim({u}, '/')
      ELSE {at} || CASE WHEN {own} = '' THEN '/' ELSE {own} END || '?' || {u} END"""
    # no lookbehind here: the slashes after a colon are put by for a moment
    collapsed = f"replace(regexp_replace(regexp_replace({out}, ':///*', ':' || chr(1), 'g'), '//+', '/', 'g'), chr(1), '//')"
    usable = f"NOT {one_of(found, rules.SKIPPED_TYPES)} AND length({found}) > 5 AND NOT contains({found}, ' ') AND NOT regexp_matches({u}, '^(?:javascript|mailto|tel|data):')"
    return usable, collapsed


#: A detector's pattern without lookaround, over a text in which each character that isn't a digit stands twice.
_TWICE = r"regexp_replace({t}, '([^0-9])', '\1\1', 'g')"


def detector(name: str, t: str) -> str:
    """The list of a detector's findings."""
    every = lambda p: f"regexp_extract_all({t}, {q(p)}, 1)"
    if name == "phone":
        return f"regexp_extract_all({_TWICE.format(t=t)}, {q(f'(?:^|[^0-9])({detect.PHONE})(?:[^0-9]|$)')}, 1)"
    if name == "resident_id":
        return f"regexp_extract_all({_TWICE.format(t=t)}, {q(f'(?:^|[^0-9])({detect.RESIDENT_ID})(?:[^0-9]|$)')}, 1)"
    if name == "private_ip":
        doubled = detect.PRIVATE_IP.replace(r"\.", r"\.\.")
        found = f"regexp_extract_all({_TWICE.format(t=t)}, {q(f'(?:^|[^0-9])({doubled})(?:[^0-9]|$)')}, 1)"
        return f"list_transform({found}, lambda x: replace(x, '..', '.'))"
    if name == "email":
        return f"list_filter({every(f'({detect.EMAIL})')}, lambda x: NOT regexp_matches(lower(x), {q(r'example.com|test.com|yourdomain|[.](?:css|js|jpg|png)$')}))"
    if name == "private_key":
        return f"CASE WHEN contains({t}, {q(detect.KEY_HEADER)}) THEN ['RSA Private Key Found'] ELSE [] END"
    if name == "password":
        return f"list_transform(list_filter({every(detect.PASSWORD)}, lambda x: NOT {one_of('lower(x)', detect.NO_PASSWORD)}), lambda x: 'Potential Password: ' || x)"
    if name == "source_map":
        return f"list_transform(regexp_extract_all(right({t}, 500), {q(detect.SOURCE_MAP)}, 1), lambda x: 'SourceMap Found: ' || x)"
    return every({"jdbc": detect.JDBC, "webhook": detect.WEBHOOK, "debug_endpoint": detect.DEBUG}[name])
