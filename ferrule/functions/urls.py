"""URLs: parts, root domains, classes, scope and resolution. All are column expressions; nulls stay null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
#: Suffixes of two labels; other hosts have one of one label.
_ROOT = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|or|org)\.(?:ar|au|br|cn|hk|id|il|in|jp|kr|mx|my|nz|sg|th|tr|tw|uk|za)|[^.]+))$"
#: A slash next to a letter or digit.
JOINED_SLASH = r"[\da-zA-Z]/|/[\da-zA-Z]"
_IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    """User, host and port as they stand; empty where there is none."""
    return F.regexp_extract(url, _NETLOC, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The port said, else 443 for https and 80 for all others."""
    said = F.regexp_extract(netloc(url), r":([0-9]{1,5})$", 1)
    return F.coalesce(F.nullif(said, F.lit("")).cast("int"), F.when(scheme(url) == "https", 443).otherwise(80))


def root_domain(url: Column) -> Column:
    """The registered domain; an address, or a host without a dot, gives the netloc as it stands."""
    h = host(url)
    root = F.regexp_extract(h, _ROOT, 1)
    return F.when(h.rlike(_IPV4) | (root == ""), netloc(url)).otherwise(root)


def without_query(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^([^?]*)", 1)


def is_static(url: Column) -> Column:
    """Whether a plain request fetches it. A fragment isn't cut off."""
    return rules.ends_with(without_query(url), rules.PLAIN)


def is_html(url: Column) -> Column:
    return rules.ends_with(without_query(url), (".htm", ".html", ".xhtml"))


def is_skipped(url: Column) -> Column:
    return rules.ends_with(without_query(url), rules.SKIPPED)


def is_unrecorded(url: Column) -> Column:
    return rules.ends_with(without_query(url), rules.UNRECORDED)


def is_script(url: Column) -> Column:
    return url.rlike(r"\.js(?:[^a-zA-Z]|$)") & ~F.contains(url, F.lit(".json"))


def classify(url: Column, seed: Column | None = None) -> Column:
    """dynamic for a seed, api where the path has no dot, static where a plain request will do, else dynamic."""
    found = F.when(~F.contains(path(url), F.lit(".")), "api").when(is_static(url), "static").otherwise("dynamic")
    return found if seed is None else F.when(seed, "dynamic").otherwise(found)


def in_scope(url: Column, roots: list[str] | Column, strict: bool = False) -> Column:
    """Whether a root stands in the netloc; with strict, whether it is the host or a parent of it. False for null and blank."""
    roots = F.array(*[F.lit(r) for r in roots]).cast("array<string>") if isinstance(roots, list) else roots
    at = netloc(url)
    one = (lambda r: (host(url) == F.lower(r)) | F.endswith(host(url), F.concat(F.lit("."), F.lower(r)))) if strict else (lambda r: F.contains(at, r))
    return rules.nonblank(url) & F.coalesce(F.exists(roots, one), F.lit(False))


def is_scannable(url: Column) -> Column:
    """A script, a page, or a path whose last segment (of the whole URL) has no dot."""
    return rules.ends_with(without_query(url), rules.SCRIPT_OR_PAGE) | ~F.contains(F.regexp_extract(without_query(url), r"([^/]*)$", 1), F.lit("."))


def is_potential_domain(text: Column) -> Column:
    """Letters before the first dot, and after it up to a slash two characters at least, a letter among them."""
    return text.rlike(r"^[^.]*\p{L}[^.]*\.[^/]*\p{L}") & text.rlike(r"^[^.]*\.[^/]{2,}") & ~F.endswith(text, F.lit("."))


def collapse_slashes(url: Column) -> Column:
    return F.regexp_replace(url, r"(?<!:)//+", "/")


def resolve_dots(path_: Column) -> Column:
    """The path without . and .. segments (RFC 3986, 5.2.4)."""
    parts = F.split(path_, "/", -1)
    last = F.element_at(parts, -1)
    keep = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.array_join(keep, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def base_parts(base: Column) -> Column:
    """What resolve needs of a page's URL, as a struct; with many links to a page it is taken once, before they are exploded."""
    base = F.when(scheme(base) == "", F.concat(F.lit("https://"), base)).otherwise(base)
    at = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.concat(F.lit("/"), F.regexp_extract(path(base), r"^/?(.*/)?[^/]*$", 1))
    return F.struct(scheme(base).alias("scheme"), at.alias("at"), F.regexp_replace(path(base), r"/+$", "").alias("own"), folder.alias("folder"), root_domain(base).alias("root"))


def resolve(found: Column, base: Column, parts: Column | None = None, allowed: list[str] | Column | None = None) -> Column:
    """The URL that a found text means on the page base, or null where it means none; see resolutions."""
    return F.try_element_at(resolutions(found, base, parts, allowed), F.lit(1))


def prefixed(found: Column, base: Column) -> Column:
    """A found text put behind its page's scheme and host, but for one that begins with http."""
    return F.when(F.startswith(found, F.lit("http")), found).otherwise(F.concat(scheme(base), F.lit("://"), netloc(base), found))


def resolutions(found: Column, base: Column, parts: Column | None = None, allowed: list[str] | Column | None = None) -> Column:
    """An array of the one URL that a found text means on the page base; empty where it means none.

    First match: a protocol-relative URL; a path from the root; a path with dots; an absolute URL; a text that looks
    like a host; a relative path; anything else as a query. Empty too where the text is a MIME type, short, has a
    space, or is of a scheme that fetches nothing, and where the result is off the page's root domain or looks like a
    static file. parts is base_parts(base) if a column has it already; allowed are root domains that count as the page's.
    """
    p = base_parts(base) if parts is None else parts
    u = F.trim(F.replace(found, F.lit("\\"), F.lit("/")))
    relative = F.regexp_extract(u, r"^([^?#]*)", 1)
    joined = F.concat(p["at"], resolve_dots(F.concat(p["folder"], relative)), F.substr(u, F.length(relative) + 1))
    out = (
        F.when(F.startswith(u, F.lit("//")), F.concat(p["scheme"], F.lit(":"), u))
        .when(F.startswith(u, F.lit("/")), F.concat(p["at"], u))
        .when(u.rlike(r"^\.\.?/"), joined)
        .when(u.rlike(r"^https?://"), u)
        .when(is_potential_domain(u), F.concat(p["scheme"], F.lit("://"), u, F.when(F.contains(u, F.lit("/")), "").otherwise("/")))
        .when(F.contains(u, F.lit("/")), F.concat(p["at"], p["own"], F.lit("/"), F.regexp_replace(u, r"^/+", "")))
        .otherwise(F.concat(p["at"], F.when(p["own"] == "", "/").otherwise(p["own"]), F.lit("?"), u))
    )
    usable = ~found.isin(*rules.SKIPPED_TYPES) & (F.length(found) > 5) & ~F.contains(found, F.lit(" ")) & ~u.rlike(r"^(?:javascript|mailto|tel|data):")
    # one element that is transformed and filtered: the long expression is evaluated once, however often it is asked about
    return F.filter(F.transform(F.array(F.when(usable, out)), collapse_slashes), lambda x: x.isNotNull() & _stays(x, p["root"], F.array(*map(F.lit, allowed)) if isinstance(allowed, list) else allowed))


def _stays(url: Column, root: Column, allowed: Column | None = None) -> Column:
    """Whether url is on the root domain, or an allowed one, and nothing in its path looks like a static file."""
    own = root_domain(url)
    there = own.eqNullSafe(root) if allowed is None else own.eqNullSafe(root) | F.coalesce(F.array_contains(allowed, own), F.lit(False))
    return there & ~rules.holds(F.lower(path(url)), rules.SKIPPED)
