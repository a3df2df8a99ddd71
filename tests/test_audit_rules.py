"""The fixed rules find what their expressions find, and search only lines that may match."""

import re

from sparkclean.operators import audit

LONG = "aB3" * 14
LINES = [
    "AKIA" + "A1" * 8, "akia" + "a1" * 8, "AIza" + "x" * 35, *(f"gh{c}_{LONG}" for c in "pousr"), "ghx_" + LONG, *(f"xox{c}-{LONG}" for c in "baprs"), "xoxb-short",
    *(f"-----BEGIN {x}PRIVATE KEY-----" for x in ("", "RSA ", "EC ", "OPENSSH ", "PGP ")), "a.P12", "b.mobileProvision", "c.PEM", "d.KeyChain", "e.pems",
    *(f"{k} = '{LONG}'" for k in ("ApiKey", "API_KEY", "api-KEY", "Secret", "PASSWD", "passWord")), "BEARER " + LONG, "İ Σ bearer\t" + LONG, "URLSession.shared", "URLSessions",
    *(f"import {x}" for x in audit.HELD["NETWORK_LIBRARY"]), "Sentryx", "x.dataTask(", "uploadTask", "downloadTask", "URLSessionWebSocketTask", "NWConnection", "NWPathMonitor",
    "http://a.b", "HTTP://a.b", "https://localhost", "https://apple.com http://x", "S3.x", "s3.amazonaws", "Storage.GoogleAPIs", "BLOB.core.windows", "DropBox", "iCloud.COM", "CloudKit", "", None,
]


def test_fixed_rules_search_only_lines_that_may_match(spark):
    lines = spark.createDataFrame([(f"i{k}", 1, x) for k, x in enumerate(LINES)], "item string, lineno int, line string")
    found = audit.scan_lines(lines)
    want = {(n, f"i{k}") for n, p in audit.RULES.items() for k, x in enumerate(LINES) if x is not None and re.search(p, x, re.ASCII)}
    assert sorted((r.rule, r.item) for r in found.collect()) == sorted(want) and {n for n, _ in want} == set(audit.RULES)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains({column}" in plan for column in ("line", "folded"))
    own = audit.scan_lines(lines, {"CLOUD_SERVICE": "^http", "OWN": "shared$"})
    assert sorted((r.rule, LINES[int(r.item[1:])]) for r in own.collect()) == [("CLOUD_SERVICE", "http://a.b"), *[("CLOUD_SERVICE", x) for x in ("https://apple.com http://x", "https://localhost")], ("OWN", "URLSession.shared")]
