"""Request parameters, methods, risk and model verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import CODE_CHARS, compress, json_part

VERDICT = "struct<has_value: int, param_keys: array<string>>"
ADVISORY = "struct<path: string, method: string, params: string>"
_NONE = "map<string,string>"


def last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays in which the last of equal keys counts, whatever spark.sql.mapKeyDedupPolicy says."""
    at = lambda k: F.element_at(values, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int"))
    distinct = F.array_distinct(keys)
    return F.map_from_arrays(distinct, F.transform(distinct, at))


def _pairs(text: Column, separator: Column) -> Column:
    items = F.filter(F.transform(F.split(text, separator, -1), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(items, lambda x: F.trim(F.substring_index(x, "=", 1)))
    values = F.transform(items, lambda x: F.when(F.contains(x, F.lit("=")), F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1))).otherwise(""))
    return last_wins(keys, values)


def _empty() -> Column:
    return F.create_map().cast(_NONE)


def stored(text: Column) -> Column:
    """a=1,b=2 as a map, maybe in one pair of brackets. A key without = has an empty value; null and empty give an empty map."""
    t = F.trim(text)
    t = F.when(t.rlike(r"(?s)^\[.*\]$"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.when(F.coalesce(t, F.lit("")) == "", _empty()).otherwise(_pairs(t, F.lit(",")))


def replayed(text: Column) -> Column:
    """A JSON object, or pairs between commas, or where there is no comma between ampersands, as a map."""
    t = F.trim(text)
    parsed = F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), F.from_json(t, _NONE))
    return F.when(F.coalesce(t, F.lit("")) == "", _empty()).otherwise(F.coalesce(parsed, _pairs(t, F.when(F.contains(t, F.lit(",")), ",").otherwise("&"))))


def to_text(params: Column) -> Column:
    """A map as JSON; null for an empty one."""
    return F.when(F.size(params) > 0, F.to_json(params))


def to_csv(params: Column) -> Column:
    """k=v joined by semicolons, which also take the place of commas; empty for null."""
    return F.coalesce(F.replace(F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(","), F.lit(";")), F.lit(""))


def stored_method(method: Column) -> Column:
    m = F.upper(F.trim(method))
    return F.when(m.isin(*rules.METHODS), m).otherwise("UNKNOWN")


def replayed_method(method: Column) -> Column:
    m = F.upper(F.trim(method))
    return F.when(m.isin(*rules.REPLAYED_METHODS), m).otherwise("GET")


def risk(path: Column, method: Column, params: Column | None = None) -> Column:
    """High, Med or Low by the words in path, method and parameters. They count anywhere: GET holds get."""
    text = F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(method, F.lit("")), F.lit(""))
    if params is not None:
        text = F.concat(text, F.coalesce(F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "), F.lit("")))
    text = F.lower(text)
    return F.when(rules.holds(text, rules.HIGH_RISK), "High").when(rules.holds(text, rules.MEDIUM_RISK), "Med").otherwise("Low")


def headers(text: Column) -> Column:
    """'k':'v' pairs as a map."""
    pair = r"'([^']*)'\s*:\s*'([^']*)'"
    return last_wins(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(pair), F.lit(2)))


def unit_interval(text: Column) -> Column:
    """The number from 0 to 1 that a text is, else null."""
    x = text.try_cast("double")
    return F.when(x.between(0, 1), x)


def verdict(answer: Column) -> Column:
    """has_value and the parameter names of more than one letter; what can't be read counts as having values."""
    j = json_part(answer)
    parsed = F.when(F.startswith(j, F.lit("{")) & F.try_parse_json(j).isNotNull(), F.from_json(j, VERDICT))
    keys = F.filter(F.coalesce(parsed["param_keys"], F.array().cast("array<string>")), lambda k: F.length(k) > 1)
    return F.struct(F.coalesce(parsed["has_value"], F.lit(1)).alias("has_value"), keys.alias("param_keys"))


def advisory(answer: Column, api_path: Column) -> Column:
    """path, method and params of a model's answer; api_path stands in for an empty path. Null for what can't be read."""
    j = json_part(answer)
    parsed = F.when(F.startswith(j, F.lit("{")) & F.try_parse_json(j).isNotNull(), F.from_json(j, ADVISORY))
    return F.when(parsed.isNotNull(), F.struct(F.coalesce(F.nullif(parsed["path"], F.lit("")), api_path).alias("path"), parsed["method"].alias("method"), parsed["params"].alias("params")))


def json_or_text(text: Column) -> Column:
    """A variant of a JSON text; a text that is no JSON as a string."""
    quoted = F.to_json(F.array(text))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.substr(quoted, F.lit(2), F.length(quoted) - 2)))


def numbered(callers: Column, most: int = 3) -> Column:
    """The first callers under numbered headings."""
    return F.array_join(F.transform(F.slice(callers, 1, most), lambda c, i: F.concat(F.lit("--- call "), (i + 1).cast("string"), F.lit(" ---\n"), c)), "\n\n")


def _shown(wrapper: Column, callers: Column) -> tuple[Column, Column]:
    """A wrapper and its first three callers as a model is shown them: compressed to half and to a sixth of CODE_CHARS."""
    first = [F.coalesce(compress(F.get(callers, F.lit(i)), CODE_CHARS // 6), F.lit("")) for i in range(3)]
    return compress(wrapper, CODE_CHARS // 2), numbered(F.slice(F.array(*first), F.lit(1), F.least(F.size(callers), F.lit(3))))


def judge_prompt(api_path: Column, wrapper: Column, callers: Column) -> Column:
    code, calls = _shown(wrapper, callers)
    return F.concat(F.lit("API: "), api_path, F.lit("\n\n[function]\n"), code, F.lit("\n\n[calls]\n"), calls)


def advice_prompt(api_path: Column, wrapper: Column, callers: Column, keys: Column) -> Column:
    hint = F.when(F.size(keys) > 0, F.concat(F.lit("Parameter names seen: "), F.array_join(keys, ", "), F.lit("\n\n"))).otherwise("")
    code, calls = _shown(wrapper, callers)
    return F.concat(hint, F.lit("[function]\n"), code, F.lit("\n\n[calls]\n"), calls, F.lit("\n\nAPI: "), api_path)
