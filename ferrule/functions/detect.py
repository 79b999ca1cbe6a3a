"""Detectors of structured sensitive data: one array of findings for each, none for null or very long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

_OCTET = r"[0-9]{1,3}"
PHONE = r"1[3-9][0-9]{9}"
EMAIL = r"[%+.\w-]+@[\d.A-Za-z-]+\.[A-Za-z]{2,}"
PRIVATE_IP = rf"(?:192\.168|172\.(?:3[01]|2[0-9]|1[6-9])|10\.{_OCTET})\.{_OCTET}\.{_OCTET}"
JDBC = r"""(?i)(jdbc:[a-z:]+://[^\s"]+)"""
RESIDENT_ID = r"[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:1[0-2]|0[1-9])(?:3[01]|0[1-9]|[12][0-9])[0-9]{3}[0-9Xx]"
KEY_HEADER = "-----BEGIN RSA" + " PRIVATE KEY-----"
PASSWORD = r"""(?i)(?:passwd|password|pwd)\s*[=:]\s*["']([^"']{6,50})["']"""
NO_PASSWORD = tuple(sorted("false true null undefined admin password 123456 ******".split()))
#: Hosts of chat webhooks and what comes before the token there.
WEBHOOKS = {"hooks.slack.com": "services/", "open.feishu.cn": "open-apis/bot/v2/hook/", "oapi.dingtalk.com": "robot/send?access_token=", "qyapi.weixin.qq.com": "cgi-bin/webhook/send?key="}
WEBHOOK = "(?i)(https://(?:%s)[\\w-]{20,100})" % "|".join(f"{host}/{path}".replace(".", r"\.").replace("?", r"\?") for host, path in WEBHOOKS.items())
DEBUG = r"""(?i)["'](/[\w/.-]*(?:actuator/env|actuator/heapdump|v2/api-docs|swagger-ui\.html))["']"""
SOURCE_MAP = r"sourceMappingURL=([\w.-]+\.js\.map)"


def _alone(pattern: str) -> str:
    """Not next to further digits."""
    return f"(?<![0-9])({pattern})(?![0-9])"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def emails_raw(text: Column) -> Column:
    return _all(text, f"({EMAIL})")


def _emails(text: Column) -> Column:
    bad = r"example\.com|test\.com|yourdomain|\.(?:css|js|jpg|png)$"
    return F.filter(emails_raw(text), lambda e: ~F.lower(e).rlike(bad))


DETECTORS = {
    "phone": lambda t: _all(t, _alone(PHONE)),
    "email": _emails,
    "private_ip": lambda t: _all(t, _alone(PRIVATE_IP)),
    "jdbc": lambda t: _all(t, JDBC),
    "resident_id": lambda t: _all(t, _alone(RESIDENT_ID)),
    "private_key": lambda t: F.when(F.contains(t, F.lit(KEY_HEADER)), F.array(F.lit("RSA Private Key Found"))).otherwise(F.array().cast("array<string>")),
    "password": lambda t: F.transform(F.filter(_all(t, PASSWORD), lambda p: ~F.lower(p).isin(*NO_PASSWORD)), lambda p: F.concat(F.lit("Potential Password: "), p)),
    "webhook": lambda t: _all(t, WEBHOOK),
    "debug_endpoint": lambda t: _all(t, DEBUG),
    "source_map": lambda t: F.transform(_all(F.right(t, F.lit(500)), SOURCE_MAP), lambda m: F.concat(F.lit("SourceMap Found: "), m)),
}


def cleaned(found: Column) -> Column:
    """Trimmed, distinct, without nulls, empty and very long ones."""
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= rules.MAX_FINDING_CHARS)))


def findings(texts: DataFrame, key: str, text: str, detectors: list[str] | None = None) -> DataFrame:
    """key, detector and value of each distinct finding. One pass over the texts, however many detectors."""
    t = F.when(F.length(text) <= rules.MAX_REGEX_CHARS, F.col(text))

    def named(detector: str) -> Column:
        values = cleaned(F.coalesce(DETECTORS[detector](t), F.array().cast("array<string>")))
        return F.transform(values, lambda v: F.struct(F.lit(detector).alias("detector"), v.alias("value")))

    each = [named(d) for d in detectors or DETECTORS]
    return texts.where(F.col(text).isNotNull()).select(F.col(key), F.explode(F.concat(*each)).alias("f")).select(key, "f.detector", "f.value")
