"""Literal cases of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkclean.functions import images, keys
from sparkclean.operators import audit, cleanup, contacts, exact, near, review, scoring, sessions
from sparkclean.operators.components import connected_components
from sparkclean.plans.scan import scan_library
from sparkclean.sources import scans

T0 = datetime(2024, 1, 1)
GRADIENT = [[c * 10 for c in range(9)] for _ in range(8)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def grid(cells):
    return F.array(*[F.array(*[F.lit(c) for c in row]) for row in cells])


def test_difference_hash(spark):
    assert one(spark, images.dhash(grid(GRADIENT)), images.dhash(grid([[7] * 9] * 8)), images.dhash(grid(GRADIENT[:7])), images.dhash(grid([r[:8] for r in GRADIENT]))) == (-1, 0, None, None)


def test_hamming(spark):
    bits = lambda n: F.lit(n).cast("long")
    assert one(spark, images.hamming(bits(0), bits(0b11111)), images.is_similar(bits(0), bits(0b11111)), images.is_similar(bits(0), bits(0b111111)), images.hamming(bits(-1), bits(0))) == (5, True, False, 64)


def test_sharpness_and_exposure(spark):
    cells = [[(x * y * 7) % 250 for x in range(5)] for y in range(4)]
    inner = [cells[y - 1][x] + cells[y + 1][x] + cells[y][x - 1] + cells[y][x + 1] - 4 * cells[y][x] for y in (1, 2) for x in (1, 2, 3)]
    mean = sum(inner) / len(inner)
    got = one(spark, images.laplacian_variance(grid(cells)), images.laplacian_variance(grid([[1, 2], [3, 4]])), images.exposure_score(grid([[0, 100], [250, 245]])))
    assert got == pytest.approx((sum((v - mean) ** 2 for v in inner) / len(inner), 0.0, 0.5))


@pytest.mark.parametrize(("raw", "normal", "last"), [("(415) 555-0123", "4155550123", "4155550123"), ("  ", None, None), ("ext", None, None), ("+1 415 555 0123", "+14155550123", "4155550123"), ("555", "555", None), (None, None, None)])
def test_phone(spark, raw, normal, last):
    c = keys.normalize_phone(F.lit(raw).cast("string"))
    assert one(spark, c, keys.phone_last10(c)) == (normal, last)


def test_phone_matches(spark):
    m = lambda a, b: keys.phones_match(F.lit(a), F.lit(b))
    assert one(spark, m("+14155550123", "+444155550123"), m("+14155550123", "4155550123"), m("4155550123", "4155550123"), m("555", "1555")) == (False, True, True, False)


def test_email(spark):
    e = F.lit("  Jane.Doe+work@Example.com ")
    assert one(spark, keys.normalize_email(e), keys.normalize_email(e, True), keys.normalize_email(F.lit(" ")), keys.email_local_part(F.lit("@foo"))) == ("jane.doe+work@example.com", "jane.doe@example.com", None, "foo")


def test_names(spark):
    s = lambda a, b: keys.name_score(F.lit(a), F.lit(b))
    same, near_, none, both, half = one(spark, s("Smith, John", "John Smith"), s("Jon", "John Smith"), s("", "x"), s("", ""), s("Jon Smith", "John Smith"))
    assert (same, none, both) == (1.0, 0.0, 1.0) and 0 < near_ < 0.7 and 0.7 < half < 1
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting")), keys.display_name(F.lit(""), F.lit("")), keys.block_letter(F.lit("Ann"), F.lit("")), keys.block_letter(F.lit(""), F.lit(""))) == (3, "(No Name)", "a", "#")


def assets(spark, data):
    full = [("l", i, t, 10, 10, size, False, "photo", T0, text) for i, t, size, text in data]
    return spark.createDataFrame(full, "library_id string, asset_id string, creation_ts timestamp, width int, height int, byte_size long, is_screenshot boolean, media_type string, modification_ts timestamp, content string")


def test_exact_duplicates(spark):
    df = assets(spark, [("a", T0, 3, "abc"), ("b", T0 - timedelta(1), 3, "abc"), ("c", None, 3, "abd"), ("d", T0, 4, "abcd"), ("e", T0, None, "abc"), ("f", None, 3, "abc")])
    got = exact.exact_duplicates(df)
    assert rows(got.select("group_id", "asset_id", "recommended_keep", "confidence")) == [("a", x, "b", 1.0) for x in "abf"]
    assert rows(exact.size_errors(df)) == [("e", "size unavailable")]


def test_nothing_hashed_without_a_partner(spark):
    df = assets(spark, [("a", T0, 3, "abc"), ("b", T0, 4, "abcd")])
    assert exact.size_buckets(exact.dimension_buckets(df.drop("content")), df).count() == 0
    assert exact.exact_duplicates(df).count() == 0 and exact.exact_duplicates(df.limit(0)).count() == 0


def test_sessions_gap_is_inclusive(spark):
    at = [0, 120, 241, 300, 1000]
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=s)) for s in at] + [("k", None)], "key string, ts timestamp")
    got = sessions.gap_sessions(df, "ts", ["key"]).groupBy("session_start").agg(F.max("session_size"))
    assert rows(got) == [(T0, 2), (T0 + timedelta(seconds=241), 2), (T0 + timedelta(seconds=1000), 1)]
    assert rows(sessions.sessions_of_two(df, "ts").groupBy("session_start").count()) == [(T0, 2), (T0 + timedelta(seconds=241), 2)]


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(63)] + [("x", "y"), ("z", "z"), ("x", "y"), ("y", None)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "u string, v string"))))
    assert set(got.values()) == {"000", "x", "z"} and got["063"] == "000" and got["y"] == "x"
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def hashes(spark, data):
    return spark.createDataFrame([("l", i, h) for i, h in data], "library_id string, asset_id string, phash long")


def test_close_hashes_join_over_a_middle(spark):
    df = hashes(spark, [("x", 0), ("y", 0b11111), ("z", 0b1111111111), ("w", None)])
    assert rows(near.similar_pairs(df, ["library_id"])) == [("x", "y", 5), ("y", "z", 5)]
    assert rows(near.hash_groups(df, ["library_id"])) == [("x", i, 1 - 5 / 64) for i in "xyz"]
    assert near.hash_groups(hashes(spark, [("a", 0), ("b", 0xFF), ("c", 0x7FFFFFFF00000000)]), ["library_id"]).count() == 0


def test_a_hundred_families(spark):
    import random

    rng = random.Random(4)
    data = []
    for f in range(100):
        base = rng.getrandbits(64)
        for k in range(20):
            h = base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            data.append((f"{f:03}-{k:02}", h - (1 << 64) if h >> 63 else h))
    got = near.hash_groups(hashes(spark, data), ["library_id"]).groupBy("group_id").count()
    assert rows(got) == [(f"{f:03}-00", 20) for f in range(100)]


def test_equal_hashes_weigh_in_the_confidence(spark):
    got = near.hash_groups(hashes(spark, [("a", 0), ("b", 0), ("c", 1)]), ["library_id"])
    assert rows(got.select("confidence").distinct()) == [(1 - (2 / 3) / 64,)]


def test_scoring(spark):
    df = spark.createDataFrame([("g", "low", 100.0, 10.0, 0.5, 1000), ("g", "high", 1000.0, 100.0, 0.9, 5000), ("h", "b", 1.0, 0.0, 0.0, 1), ("h", "a", 1.0, 0.0, 0.0, 1)], "group_id string, asset_id string, resolution double, sharpness double, exposure double, byte_size long")
    got = {r.asset_id: r for r in scoring.scored(scoring.weighted(df)).collect()}
    assert got["low"].recommended_keep == "high" and got["b"].recommended_keep == "a"
    assert got["high"].reason == "Highest resolution, sharpest of 2." and got["low"].reason.startswith("Lower overall quality") and got["b"].reason == "Highest resolution of 2."


def test_grey_grid(spark):
    pixels = spark.createDataFrame([("a", x, y, 10 * (x // 2) + y // 2) for x in range(4) for y in range(4)] + [("tiny", 0, 0, 1)], "asset_id string, x int, y int, luma int")
    assert rows(near.grey_grid(pixels, 2, 2)) == [("a", [[0, 10], [1, 11]])]


def raw_contacts(spark, data):
    return spark.createDataFrame([(i, g, f, p, e, im) for i, g, f, p, e, im in data], "contact_id string, given string, family string, phones array<string>, emails array<string>, has_image boolean")


def linked(spark, data):
    raw = raw_contacts(spark, data)
    groups, members = contacts.link_contacts(contacts.contact_scan(raw))
    return raw, groups, members


def test_linkage(spark):
    raw, groups, members = linked(spark, [
        ("a", "John", "Smith", ["(415) 555-0123"], [], False), ("b", "J", "S", ["415 555 0123"], ["x@y.z"], True), ("c", "Ann", "Lee", ["+1 212 555 0000"], [], False),
        ("d", "Ann", "Lee", ["+44 212 555 0000"], [], False), ("e", "Same", "Name", [], [], False), ("f", "Same", "Name", [], [], False),
    ])
    assert rows(groups.select("group_id", "tier", "confidence", "recommended_primary")) == [("a", "exact", 1.0, "b"), ("c", "probable", 0.75, "c")]
    assert rows(members) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")]
    diffs = rows(contacts.field_diffs(groups, members, raw).select("contact_id", "label", "primary_value", "other_value", "is_loss").fillna("-"))
    assert ("a", "Phone", "-", "(415) 555-0123", True) in diffs and ("a", "Email", "x@y.z", "-", False) in diffs and ("a", "Name", "J S", "John Smith", False) in diffs


def test_large_groups_are_not_trusted(spark):
    _, groups, _ = linked(spark, [(f"c{i}", "N", str(i), ["5551234567"], [], False) for i in range(9)])
    r = groups.first()
    assert (r.tier, r.confidence, r.n_members) == ("probable", 0.375, 9) and r.match_reason.startswith("Large group of 9")


def test_orders(spark):
    df = spark.createDataFrame([("a", 100, T0), ("b", 300, None), ("c", 200, T0 + timedelta(1)), ("d", 300, T0)], "asset_id string, byte_size long, creation_ts timestamp")
    assert [r[0] for r in sorted(review.largest_first(df).select("asset_id", "rank").collect(), key=lambda r: r.rank)] == ["b", "d", "c", "a"]
    assert [r[0] for r in sorted(review.newest_first(df).select("asset_id", "rank").collect(), key=lambda r: r.rank)] == ["c", "a", "d", "b"]


def group(spark, members, keep, user=None):
    groups = spark.createDataFrame([("g", keep, user)], "group_id string, recommended_keep string, user_keep string")
    return groups, spark.createDataFrame([("g", m, i, 10, s) for i, (m, s) in enumerate(members)], "group_id string, asset_id string, member_pos int, byte_size long, selected boolean")


def test_prune(spark):
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id string")
    groups, members = group(spark, [("a", False), ("b", True), ("c", True)], "a")
    left, rest = cleanup.prune(groups, members, gone("a"))
    assert rows(left) == [("g", "b", None)] and rows(rest.select("asset_id", "selected")) == [("b", False), ("c", True)]
    left, rest = cleanup.prune(groups, members, gone("a", "b"))
    assert left.count() == rest.count() == 0


def test_replay(spark):
    groups, members = group(spark, [("a", False), ("b", False), ("c", False)], "a")
    log = spark.createDataFrame([(1, "g", "b", "toggle"), (2, "g", "a", "toggle"), (3, "g", None, "select_all"), (4, "g", "c", "toggle"), (5, "g", "b", "set_keep"), (6, "g", "zz", "toggle"), (7, "g", "a", "toggle")], "seq long, group_id string, item_id string, op string")
    assert rows(review.replay(log, members, groups).select("asset_id", "selected")) == [("a", True), ("b", False), ("c", False)]
    assert rows(review.replay(log.limit(0), members, groups).select("selected").distinct()) == [(False,)]


def test_cleanup(spark):
    selection = spark.createDataFrame([("photo", "p1"), ("screenshot", "p1"), ("photo", "p2"), ("contact", "c1"), ("video", "v1")], "category string, item_id string")
    live = spark.createDataFrame([("p1",), ("c1",), ("v1",)], "item_id string")
    grants = spark.createDataFrame([("media", True), ("contacts", False)], "domain string, usable boolean")
    outcomes = spark.createDataFrame([("p1", True), ("v1", False)], "item_id string, confirmed boolean")
    capacity = spark.createDataFrame([("before", 100, 10), ("after", 100, 25)], "phase string, total long, available long")
    with pytest.raises(cleanup.NothingToDo):
        cleanup.run_cleanup(selection, live, grants, outcomes, capacity, confirmed=False)
    with pytest.raises(cleanup.NothingToDo):
        cleanup.run_cleanup(selection.limit(0), live, grants, outcomes, capacity, confirmed=True)
    done = cleanup.run_cleanup(selection, live, grants, outcomes, capacity, confirmed=True)
    assert rows(done["failures"].select("category", "item_id", "reason")) == [("contact", "c1", "permissionRevoked"), ("photo", "p2", "staleIdentifier"), ("video", "v1", "frameworkError")]
    assert rows(done["summary"]) == [("contact", 1, 0, 1, False), ("photo", 2, 1, 1, True), ("screenshot", 1, 1, 0, False), ("video", 1, 0, 1, False)]
    assert done["bytes_freed"].first()[0] == 15 and cleanup.bytes_freed(capacity.where("phase = 'after'")).first()[0] == 0
    assert cleanup.storage_summary(capacity.where("false"), review.recoverable_total(selection.withColumn("byte_size", F.lit(1)))).count() == 0


def test_recoverable(spark):
    df = spark.createDataFrame([("photo", "x", 7), ("screenshot", "x", 7), ("video", "v", 500), ("contact", "c", 9)], "category string, item_id string, byte_size long")
    assert rows(review.recoverable_total(df)) == [(523, 516)]
    assert rows(review.recoverable_by_category(df)) == [("contact", 0), ("photo", 7), ("screenshot", 7), ("video", 500)]
    assert rows(review.recoverable_by_category(df.limit(0))) == [(c, 0) for c in sorted(review.CATEGORIES)]


HITS = {
    "SECRET_AWS_ACCESS_KEY": "AKIA" + "A" * 16, "SECRET_GOOGLE_API_KEY": "AIza" + "b" * 35, "SECRET_GITHUB_TOKEN": "ghp_" + "c" * 36, "SECRET_SLACK_TOKEN": "xoxb-" + "1" * 12,
    "SECRET_PRIVATE_KEY_BLOCK": "-----BEGIN RSA PRIVATE KEY-----", "SECRET_P12_OR_MOBILEPROVISION": "my.P12 file", "SECRET_GENERIC_APIKEY_LITERAL": 'api_key = "abcdefghijklmnop"', "SECRET_BEARER_LITERAL": "Bearer " + "t" * 20,
    "NETWORK_URLSESSION": "let s = URLSession.shared", "NETWORK_LIBRARY": "import Sentry", "NETWORK_DATA_TASK": "x.dataTask(y)", "NETWORK_WEBSOCKET": "NWConnection()", "NETWORK_HTTP_URL": "see http://example.org/x", "CLOUD_SERVICE": "my Dropbox folder",
}


def test_every_rule_finds_its_line(spark):
    texts = spark.createDataFrame([(r, f"plain\n{line}\nhttps://apple.com/x") for r, line in HITS.items()] + [("none", None)], "item string, text string")
    found = audit.scan_lines(audit.text_lines(texts))
    assert rows(found) == sorted((r, r, 2) for r in audit.RULES)
    allowed = spark.createDataFrame([("CLOUD_SERVICE", "CLOUD_SERVICE")], "rule string, item string")
    assert audit.without_allowed(found, allowed).count() == len(audit.RULES) - 1
    assert set(rows(audit.verdict(audit.without_allowed(found, allowed)))) == {(r, int(r != "CLOUD_SERVICE"), r == "CLOUD_SERVICE") for r in audit.RULES}


def test_snapshot_version(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "asset_id string, byte_size long")
    scans.save_snapshot(df, str(tmp_path / "s"), ["asset_id", "byte_size"])
    assert rows(scans.load_snapshot(spark, str(tmp_path / "s"), "asset_id string, byte_size long")) == [("a", 1)]
    scans.save_snapshot(df, str(tmp_path / "s"), ["asset_id", "byte_size"], version=2)
    assert scans.load_snapshot(spark, str(tmp_path / "s"), "asset_id string, byte_size long").count() == 0


def test_scan_library(spark):
    df = assets(spark, [("a", T0, 3, "abc"), ("b", T0, 3, "abc"), ("c", T0, 5, "x"), ("d", T0 + timedelta(seconds=60), 6, "y")])
    h = spark.createDataFrame([(i, 5) for i in "abcd"], "asset_id string, phash long")
    s = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1) for i in "abcd"], "asset_id string, resolution double, sharpness double, exposure double, byte_size long")
    found = scan_library(df, h, s)
    assert rows(found["exact"].select("asset_id")) == [("a",), ("b",)] and rows(found["similar"].select("asset_id")) == [("c",), ("d",)] and found["videos"].count() == 0


# --- snapshots, files, staged tables ---


def test_snapshots_missing_unreadable_and_replaced(spark, tmp_path):
    from pathlib import Path

    from sparkclean.sources import scans

    path, schema = str(tmp_path / "snapshot"), "asset_id string, byte_size long"
    load = lambda: sorted(map(tuple, scans.load_snapshot(spark, path, schema).collect()))
    assert load() == [] and not scans.drop_snapshot(spark, path)
    scans.save_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], schema), path, ["asset_id", "byte_size"])
    assert load() == [("a", 1), ("b", 2)]
    (tmp_path / "snapshot" / "99999999999999999999-dead").mkdir()  # a job that died while it wrote
    scans.save_snapshot(scans.load_snapshot(spark, path, schema).where("byte_size > 1"), path, ["asset_id", "byte_size"])
    assert load() == [("b", 2)]
    for part in Path(path).rglob("part-*"):
        part.write_bytes(b"broken")
    for crc in Path(path).rglob(".*.crc"):
        crc.unlink()
    assert load() == []
    assert scans.drop_snapshot(spark, path) and load() == []


def test_source_lines(spark, tmp_path):
    from sparkclean.sources import scans

    for name, text in {"a.swift": "x\ny", "sub/b.PY": "z", "build/c.swift": "no", "sub/d.txt": "no", "e e.py": "one"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = sorted(map(tuple, scans.source_lines(spark, str(tmp_path), ["swift", ".py"], ["build"]).collect()))
    assert got == [("a.swift", 1, "x"), ("a.swift", 2, "y"), ("e e.py", 1, "one"), ("sub/b.PY", 1, "z")]


def test_staged_tables_go(spark):
    from sparkclean import storage

    kept = storage.stage(spark.range(3))
    gone = storage.stage(spark.range(4))
    path = storage.staged()[-1]
    storage.drop_staged(spark, [path])
    assert path not in storage.staged() and kept.count() == 3 and not spark._jvm.java.io.File(path.removeprefix("file:")).exists()
    assert gone is not None
