"""Line-level scans of text by rules, allow-lists and token lists; matched text is never reported."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules by name, as regular expressions: fixed values.
RULES = {
    "SECRET_AWS_ACCESS_KEY": r"AKIA[0-9A-Z]{16}",
    "SECRET_GOOGLE_API_KEY": r"AIza[0-9A-Za-z_\-]{35}",
    "SECRET_GITHUB_TOKEN": r"gh[pousr]_[0-9A-Za-z]{36,}",
    "SECRET_SLACK_TOKEN": r"xox[baprs]-[0-9A-Za-z\-]{10,}",
    "SECRET_PRIVATE_KEY_BLOCK": r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    "SECRET_P12_OR_MOBILEPROVISION": r"(?i)\.(p12|mobileprovision|pem|keychain)\b",
    "SECRET_GENERIC_APIKEY_LITERAL": r"""(?i)(api[_-]?key|secret|passwd|password)\s*[:=]\s*["'][A-Za-z0-9_\-/.+]{16,}["']""",
    "SECRET_BEARER_LITERAL": r"(?i)bearer\s+[A-Za-z0-9_\-/.]{20,}",
    "NETWORK_URLSESSION": r"\bURLSession\b",
    "NETWORK_LIBRARY": r"\b(Alamofire|Firebase|Mixpanel|Amplitude|Sentry|Crashlytics|Analytics)\b",
    "NETWORK_DATA_TASK": r"\bdataTask\b|\buploadTask\b|\bdownloadTask\b",
    "NETWORK_WEBSOCKET": r"\bURLSessionWebSocketTask\b|\bNWConnection\b|\bNWPathMonitor\b",
    "NETWORK_HTTP_URL": r"\bhttps?://(?!localhost|127\.0\.0\.1|apple\.com|developer\.apple\.com|help\.apple\.com)[A-Za-z0-9.\-]+",
    "CLOUD_SERVICE": r"(?i)\b(S3\.|s3\.amazonaws|storage\.googleapis|blob\.core\.windows|dropbox|icloud\.com|cloudkit)\b",
}

#: Strings of which every match of the rule holds one, in lower case for rules that take either case.
HELD = {
    "SECRET_AWS_ACCESS_KEY": ["AKIA"],
    "SECRET_GOOGLE_API_KEY": ["AIza"],
    "SECRET_GITHUB_TOKEN": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "SECRET_SLACK_TOKEN": ["xox"],
    "SECRET_PRIVATE_KEY_BLOCK": ["PRIVATE KEY-----"],
    "SECRET_P12_OR_MOBILEPROVISION": [".p12", ".mobileprovision", ".pem", ".keychain"],
    "SECRET_GENERIC_APIKEY_LITERAL": ["apikey", "api_key", "api-key", "secret", "passwd", "password"],
    "SECRET_BEARER_LITERAL": ["bearer"],
    "NETWORK_URLSESSION": ["URLSession"],
    "NETWORK_LIBRARY": ["Alamofire", "Firebase", "Mixpanel", "Amplitude", "Sentry", "Crashlytics", "Analytics"],
    "NETWORK_DATA_TASK": ["dataTask", "uploadTask", "downloadTask"],
    "NETWORK_WEBSOCKET": ["URLSessionWebSocketTask", "NWConnection", "NWPathMonitor"],
    "NETWORK_HTTP_URL": ["http://", "https://"],
    "CLOUD_SERVICE": ["s3.", "storage.googleapis", "blob.core.windows", "dropbox", "icloud.com", "cloudkit"],
}


def _matches(name: str, pattern: str) -> Column:
    """Whether ``line`` matches; a fixed rule's expression is tried only on lines that hold one of its strings."""
    found = F.col("line").rlike(pattern)
    if RULES.get(name) != pattern:
        return found
    text = F.col("folded" if pattern.startswith("(?i)") else "line")
    return reduce(or_, [text.contains(x) for x in HELD[name]]) & found


def text_lines(texts: DataFrame, item: str = "item", text: str = "text") -> DataFrame:
    """``(item, lineno, line)``, line numbers from 1; a null text has no lines."""
    return texts.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).select("item", (F.col("pos") + 1).alias("lineno"), "line")


def scan_lines(lines: DataFrame, rules: dict[str, str] = RULES, skip: list[str] | None = None) -> DataFrame:
    """``(rule, item, lineno)`` for each rule that a line matches, without the items in ``skip``.

    All rules are tried in one pass over the lines; there is no product of lines and rules.
    """
    if skip:
        lines = lines.where(~F.col("item").isin(skip))
    hits = F.array_compact(F.array(*[F.when(_matches(name, pattern), F.lit(name)) for name, pattern in rules.items()]))
    folded = lines.select("item", "lineno", "line", F.lower("line").alias("folded"))
    return folded.select("item", "lineno", F.explode(hits).alias("rule")).select("rule", "item", "lineno")


def without_allowed(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings whose ``(rule, item)`` is not on the allow-list."""
    return findings.join(allowed.select("rule", "item").distinct(), ["rule", "item"], "left_anti")


def verdict(findings: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``(rule, n_findings, passed)`` for every rule."""
    names = findings.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    counts = findings.groupBy("rule").agg(F.count("*").alias("n"))
    return names.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("n", F.lit(0)).alias("_n")).withColumn("passed", F.col("_n") == 0).drop("_n")


def tokens_off_list(lines: DataFrame, pattern: str, listed: list[str], deny: bool = False) -> DataFrame:
    """``(item, lineno, token)``: the token that ``pattern`` takes from a line (group 1), where it is not on the list.

    With ``deny`` the list names what is refused, and tokens on it are reported.
    """
    found = lines.select("item", "lineno", F.regexp_extract("line", pattern, 1).alias("token")).where("token <> ''")
    on = F.col("token").isin(listed)
    return found.where(on if deny else ~on)
