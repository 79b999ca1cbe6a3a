"""Rule tables. They are small and fixed, so they go into plans as literals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dotted(names: str) -> tuple[str, ...]:
    return tuple(f".{n}" for n in sorted(names.split()))


#: Never worth fetching. Pages ending in html are among them, scripts are not.
SKIPPED = _dotted("apk exe swf  css eot otf ttf woff2 woff  webp svg png jpeg jpg ico gif  mp4 mp3 m4v aac  htm html")
#: Fetched without a browser.
PLAIN = _dotted("xml xlsx xls txt map csv json js  wav aac m4v mp3 mp4  svg webp gif ico jpeg jpg png  ttf otf eot woff woff2 css  swf exe apk  htm html")
#: Not recorded as discovered edges.
UNRECORDED = _dotted("tsx jsx ts vue js css  webm wav mp3 mp4  eot ttf woff2 woff  webp ico svg gif jpeg jpg png")
SCRIPT_OR_PAGE = (".htm", ".html", ".js")
NOT_API = (".css", ".ico", ".jpg", ".png", ".woff")

HIGH_RISK = tuple(sorted("withdraw transfer refund order payment restore backup export import upload token auth email password create remove delete update permission role user admin".split()))
MEDIUM_RISK = tuple(sorted("setting config account profile detail info get list query search".split()))
METHODS = tuple(sorted("OPTIONS HEAD PATCH DELETE PUT POST GET".split()))
REPLAYED_METHODS = ("GET", "POST", "PUT")
BLOCKED_RESOURCES = tuple(sorted("stylesheet font media image".split()))
SKIPPED_TYPES = tuple(sorted("text/plain text/html image/svg+xml image/jpeg image/jpg image/gif".split()))

#: What pages say that want a log-in.
LOGIN_WORDS = tuple(
    sorted(
        "401|login|signin|jwt expired|invalid token|token expired|sign in required|please login|access denied|session expired|authentication required|login required|not logged in|unauth|unauthorized|"
        "认证失败|会话已过期|登录失效|重新登录|请登录|身份验证失败|未授权|会话过期|登录过期|请先登录|未登录".split("|")
    )
)

SECRET_WORDS = tuple(sorted("environment env setting config xsrf csrf cookie session private_key private access api bearer jwt cert credential pwd pass password auth token secret key".split()))
PLAIN_VALUES = tuple(sorted("unicode base64 localhost https form input button reset submit sidebar footer header dashboard admin user signin signup register logout login index home color grey gray black white green delete undefined false".split()))
NOT_SECRET = ("&lt;", "0000000000", "123456789", "ABCDEFGHIJKLMNOP", "I18N", "abcdefghijklmnop")
TECHNICAL_WORDS = tuple(sorted("microsoft laravel config gitlab href github admin django bitbucket params redis webpack facebook json const i18n".split()))
#: Code around a literal that says it is no secret.
HARMLESS_CODE = tuple(
    sorted(
        "_sentryDebugIds|document.cookie|window.location|<style|<script|<link|<img|<a |<span|<div|.attr(|.val(|.text(|.html(|.css(|textContent|innerHTML|appendChild|createElement|getElementsByClassName|"
        "getElementsByTagName|querySelectorAll|querySelector|getElementById|export |require(|import |logger.error|logger.warn|logger.info|logger.debug|logger.log|prompt(|confirm(|alert(|"
        "console.debug|console.info|console.error|console.warn|console.log".split("|")
    )
)

MAX_PAGE_CHARS, MIN_PAGE_CHARS, MAX_DUPLICATE_CHARS = 20 * 1024 * 1024, 200, 712_000
MAX_REGEX_CHARS, MAX_FINDING_CHARS, SUMMARY_CHARS = 1_000_000, 500, 500


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words."""
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\&", "&").replace(r"\<", "<").replace(r"\-", "-") for w in words)


def ends_with(text: Column, endings: tuple[str, ...]) -> Column:
    return text.rlike(f"(?:{any_of(endings)})$")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in text. Plain searches one after another, the first hit ends them.

    The text is an array's one element: what it is made by is evaluated once, not for each word.
    """
    return F.exists(F.array(text), lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words)))


def nonblank(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))
