"""Text of pages, scripts, responses and model answers."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .urls import JOINED_SLASH

#: Applied in order; each is a pattern that Java and RE2 read alike, and what takes its place.
MINIFY = (
    (r"""["']image/[A-Za-z]*;base64,[^'"]*["']""", '"[IMG]"'),
    (r"""["'][^'"]*[#.][\w-]+\s*[{][^}]*:[^}]*[}][^'"]*["']""", '"[CSS]"'),
    (r"""["'][^'"]*<[a-z](?:[^>]*)>[^'"]*["']""", '"[HTML]"'),
    (r"""\[(?:\s*["'][A-Za-z0-9]{2,}["']\s*,?){50,}\]""", '"[ARRAY]"'),
    (r"(?s)/\*.*?\*/", ""),
    (r"//[^\n]*", ""),
    (r"\s+", " "),
    (r"console\.[A-Za-z]+\([^)]*\)", ""),
    (r"logger\.[A-Za-z]+\([^)]*\)", ""),
)
#: Fields of a response that change from one to the next.
VOLATILE = tuple((rf'"{name}"\s*:\s*{value}', f'"{name}":{quote}{{{{DYNAMIC}}}}{quote}') for name, value, quote in [*[(n, '"[^"]*"', '"') for n in ("requestId", "traceId", "nonce", "uuid", "sign")], ("timestamp", "[0-9]+", "")])
PROTECTED = tuple("auth axios body data fetch get http key params payload permission post query request secret sign token".split())
CUT, CUT_KEPT = "\n\n/*...[cut]...*/\n\n", "\n\n/*...[cut, key functions kept]...*/\n\n"
CODE_CHARS = 12_000
PRE = r"(?is)<pre\b[^>]*>(.*?)</pre\s*>"
LINE_ENDS = "[\u2028\u2029]"
UNSEEN = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\u200b-\u200f\ufeff]"


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by.replace("$", r"\$"))
    return text


def unwrap_pre(html: Column) -> Column:
    """The bodies of all pre elements, a line each, of a text that begins as markup; any other text as it is."""
    found = F.regexp_extract_all(html, F.lit(PRE), F.lit(1))
    markup = F.startswith(F.trim(html), F.lit("<")) & F.contains(F.substring(F.trim(html), 1, 500), F.lit(">"))
    return F.when(markup & (F.size(found) > 0), F.array_join(found, "\n")).otherwise(html)


def first_pre(html: Column) -> Column:
    """The trimmed text of the pre that browsers wrap scripts in, else of the first pre, else the text itself."""
    wrapped = r"""(?is)<pre[^>]*style="%s"[^>]*>(.*?)</pre>""" % "".join(f"{rule};{gap}" for rule, gap in (("word-wrap: break-word", " "), ("white-space: pre-wrap", "")))
    body = F.coalesce(F.nullif(F.regexp_extract(html, wrapped, 1), F.lit("")), F.nullif(F.regexp_extract(html, PRE, 1), F.lit("")))
    plain = F.replace(F.replace(F.replace(F.replace(F.regexp_replace(body, "<[^>]+>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(F.trim(plain), html)


def strip_tags(text: Column) -> Column:
    """Without tags and with single spaces; a null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), r"\s+", " "))


def summary(text: Column) -> Column:
    return F.substring(strip_tags(text), 1, rules.SUMMARY_CHARS)


def normalize_response(text: Column) -> Column:
    """Without white space and with volatile fields masked; a null is empty."""
    return F.regexp_replace(_replaced(F.coalesce(text, F.lit("")), VOLATILE), r"\s+", "")


def fingerprint(text: Column) -> Column:
    return F.md5(normalize_response(text))


def status_priority(status: Column) -> Column:
    return F.when(status.isin(401, 403) | (status >= 500), 3).when(status == 404, 1).otherwise(2)


def sanitize(code: Column) -> Column:
    """With plain line ends, and without control and zero-width characters."""
    return F.regexp_replace(F.regexp_replace(code, LINE_ENDS, "\n"), UNSEEN, "")


def break_lines(code: Column) -> Column:
    """A line end after each semicolon and opening brace of a script too large for a formatter; others as they are."""
    huge = (F.length(code) > 1 << 20) & F.contains(F.substring(code, 1, 10_000), F.lit(";"))
    return F.when(huge, F.replace(F.replace(code, F.lit(";"), F.lit(";\n")), F.lit("{"), F.lit("{\n"))).otherwise(code)


def minify(code: Column) -> Column:
    """Without what says nothing about requests. A // cuts its line even within a string."""
    return _replaced(code, MINIFY)


_HEAD = re.compile(r"function\s+\w+|\w+\s*[:=]\s*(?:async\s+)?function")
#: Letters and numbers that Unicode took in after its version 13, up to 15.1: Python's words have them, those of Java 17 don't.
_NEW = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 "
    "a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc "
    "10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 "
    "11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 "
    "1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad "
    "1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d "
    "31350-323af"
)
#: _HEAD for Java, with Python's words and spaces. What it passes it doesn't read again: a name's end can't begin a match that the whole name doesn't, unless the last match ended there.
_WORD = r"[\p{L}\p{N}_[\p{Cn}&&[%s]]]" % re.sub(r"[\da-f]+", r"\\x{\g<0>}", _NEW).replace(" ", "")
_BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_HEAD_JVM = rf"function{_BLANK}++{_WORD}++|(?:\G|(?<!{_WORD})){_WORD}++{_BLANK}*+[:=]{_BLANK}*+(?:async{_BLANK}++)?function"
#: Set before each head; a text's own are other characters meanwhile, which no pattern knows either.
_MARK, _NO_MARK = "\0", "\1"


def truncated(code: str, limit: int) -> str:
    """Code of at most limit + 100 characters that keeps the functions with protected words, in order, while they fit."""
    if len(code) <= limit:
        return code
    heads = [m.start() for m in _HEAD.finditer(code)]
    if not heads:
        return code[:limit] + CUT
    end = total = 0
    for a, z in zip(heads, [*heads[1:], len(code)]):
        if not any(w in code[a:z] for w in PROTECTED):
            continue
        if total + z - a > limit * 0.8:
            break
        total, end = total + z - end, z
    kept = code[: end + max(0, limit - total)]
    return (kept + CUT_KEPT if len(kept) < len(code) else kept)[: limit + 100]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def structural_truncate(code: Column, limit: int) -> Column:
    """truncated() as a fold over the parts that heads begin, in built-ins: a text goes to no worker, and none waits in a batch.

    What is kept ends with the last part taken, or at limit if that lies further on.
    """

    def step(s: Column, part: Column) -> Column:
        at, headed, end = s["at"] + F.length(part), s["n"] > 0, s["end"]  # before the first head there is no part to keep
        fits = end + F.length(part) <= F.lit(limit * 0.8)
        protected = reduce(lambda a, b: a | b, (F.contains(part, F.lit(w)) for w in PROTECTED))
        taken = headed & s["open"] & fits & protected
        return F.struct((s["n"] + 1).alias("n"), at.alias("at"), F.when(taken, at).otherwise(end).alias("end"), (~headed | (s["open"] & (fits | ~protected))).alias("open"))

    def cut(c: Column) -> Column:
        parts = F.split(F.regexp_replace(F.replace(c, F.lit(_MARK), F.lit(_NO_MARK)), _HEAD_JVM, _MARK + "$0"), _MARK, -1)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(True).alias("open"))

        def kept(s: Column) -> Column:
            end = F.greatest(s["end"], F.lit(limit))
            return F.substring(F.concat(F.substring(c, F.lit(1), end), F.when(end < F.length(c), CUT_KEPT).otherwise("")), 1, limit + 100)

        return F.aggregate(parts, start, step, lambda s: F.when(s["n"] > 1, kept(s)).otherwise(F.concat(F.substring(c, 1, limit), F.lit(CUT))))

    return _let(code, lambda c: F.when(F.length(c) > limit, cut(c)).otherwise(c))


def compress(code: Column, limit: int = CODE_CHARS) -> Column:
    return structural_truncate(minify(code), limit)


def relevant_lines(code: Column) -> Column:
    """The lines of a script that may hold an API path, cleaned, in order; empty where there is none."""
    line = F.transform(F.split(code, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    wanted = F.filter(line, lambda x: (x != "") & ~F.startswith(x, F.lit("//")) & (F.length(x) <= 800) & x.rlike("/|http|api|=|:"))
    bare = F.transform(wanted, lambda x: F.replace(F.regexp_replace(F.regexp_replace(x, r"(?<!:)//.*$", ""), r"\s+$", ""), F.lit("\\"), F.lit("")))

    def has_path(x: Column) -> Column:
        quoted = F.regexp_extract_all(x, F.lit(r"""["'](.*?)["']"""), F.lit(1))
        return F.exists(quoted, lambda q: ~rules.ends_with(F.lower(q), rules.SKIPPED) & ~q.rlike(r"[\\|{}()\[\]$^?+*]") & q.rlike(JOINED_SLASH))

    kept = F.filter(bare, lambda x: (x != "") & ~x.rlike(r"<\s*(?:/\s*)?[A-Za-z][^>]*>") & has_path(x))
    return F.coalesce(F.array_join(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), "\n"), F.lit(""))


def without_fences(answer: Column) -> Column:
    """A model's answer without its thinking and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?is)<think>.*?</think>", ""), "```(?:json)?", ""))


def json_part(answer: Column) -> Column:
    """The JSON in a model's answer: as it begins, from a fence, or from the first to the last brace; else empty."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    fenced = r"(?is)`{3}(?:json)?[ \n\r\t]*(.*?)[ \n\r\t]*`{3}"
    braces = r"(?s)(\{.*\})"
    return F.when(a.rlike(r"^[{\[]"), F.trim(F.regexp_replace(a, "```$", ""))).when(a.rlike(fenced), F.regexp_extract(a, fenced, 1)).otherwise(F.regexp_extract(a, braces, 1))
