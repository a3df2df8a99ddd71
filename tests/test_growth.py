"""Joins and groups that stay linear, stores with generations, and streams that can be replayed."""

import hashlib
import random
import re
import time
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclean.functions import images, keys
from sparkclean.operators import contacts, growing, near, review, sessions, similar_text
from sparkclean.operators.components import connected_components, contracted
from sparkclean.plans import queries, scan, views
from sparkclean.sources import generations, scans
from sparkclean.streaming import streams

T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def groups_of(edges):
    """The sets of nodes that edges join."""
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for u, v in edges:
        above[max(top(u), top(v))] = min(top(u), top(v))
    out = defaultdict(set)
    for x in above:
        out[top(x)].add(x)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- components ---


def test_contracted_forests_join_the_same(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(700)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for held in (1 << 20, 40, 3):
        got = rows(contracted(df, held))
        assert groups_of(got) == groups_of(edges) and all(u > v for u, v in got)
    named = dict(rows(connected_components(df)))
    assert {frozenset(x for x in named if named[x] == c) for c in named.values()} == groups_of(edges)


# --- close texts ---


def score(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_edit_distances():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé日") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    a, b = zip(*[(rng.choice(texts), rng.choice(texts)) for _ in range(500)])
    want = [round((1 - score(x, y)) * max(len(x), len(y), 1)) for x, y in zip(a, b)]
    assert similar_text.edit_distances(list(a), list(b)).tolist() == want


def test_rare_grams_of_close_texts_meet():
    rng = random.Random(4)
    for limit in (0.9, 0.8, 0.7):
        size = similar_text.gram_size(limit)
        for _ in range(300):
            a = "".join(rng.choice("abc") for _ in range(rng.randint(10, 45)))
            b = list(a)
            for _ in range(similar_text.tolerated(len(a), limit)):
                at = rng.randrange(len(b))
                b[at : at + 1] = rng.choice([[], ["x"], ["y", b[at]]])
            b = "".join(b)
            if score(a, b) >= limit:
                common = {"abc"[i : i + size]: i for i in range(2)}
                grams = [set(similar_text.rare_grams(t, size, similar_text.most_tolerated(len(t), limit), common)) for t in (a, b)]
                assert grams[0] & grams[1]


@pytest.mark.parametrize(("limit", "piece"), [(0.9, 512), (0.9, 3), (0.75, 512)])
def test_close_texts(spark, limit, piece):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 44)))
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t)) if t else 0
                t[at : at + 1] = rng.choice([[], [rng.choice("abx")], [rng.choice("ab"), *t[at : at + 1]]])
            texts.append((rng.choice("pq"), "".join(t)))
    data = [*texts, texts[0], ("p", None), (None, "abc")]
    got = rows(similar_text.close_texts(spark.createDataFrame(data, "k string, t string"), ["k"], "t", limit, piece))
    pairs = [((k, a), (k, b)) for k in "pq" for a in {t for x, t in texts if x == k} for b in {t for x, t in texts if x == k} if a < b and score(a, b) >= limit]
    assert all(score(a, b) >= limit for _, a, b in got)
    assert groups_of([((k, a), (k, b)) for k, a, b in got]) == groups_of(pairs)


def test_a_hot_address_gives_links_not_pairs(spark):
    """100,000 contacts share the first part of their addresses; names fall into 100 families and 10,000 single ones."""
    n = 100_000
    i = F.col("id")
    family = F.lpad((i % 100).cast("string"), 3, "0")
    given = F.when(i % 10 != 1, F.concat(F.lit("Desk "), family, F.lit(" Berlin Office "), F.translate(F.lpad((i % 7).cast("string"), 1, "0"), "0123456", "abcdefg")))
    given = F.coalesce(given, F.concat(F.lit("P"), F.substring(F.md5(i.cast("string")), 1, 14)))
    raw = spark.range(n).select(
        F.lpad(i.cast("string"), 8, "0").alias("contact_id"), given.alias("given"), F.lit("").alias("family"), F.array().cast("array<string>").alias("phones"),
        F.array(F.concat(F.lit("info@d"), i.cast("string"), F.lit(".example"))).alias("emails"), F.lit(False).alias("has_image"),
    )
    found = contacts.contact_scan(raw)
    links = contacts.name_links(found, contacts.entries(found))
    data = {r.contact_id: r.given.lower() for r in raw.select("contact_id", "given").collect()}
    got = rows(links, "u", "v")
    assert len(got) < 4 * n
    names = defaultdict(set)
    for c, name in data.items():
        names[name].add(c)
    desks = sorted(x for x in names if x.startswith("desk"))
    close = [(a, b) for k, a in enumerate(desks) for b in desks[k + 1 :] if sum(x != y for x, y in zip(a, b)) <= 2]  # same length, two edits of 24
    want = groups_of([(min(names[a]), min(names[b])) for a, b in close] + [(min(g), c) for g in names.values() for c in g])
    assert groups_of(got) == want
    weak = contacts.weak_classes(contacts.entries(found), "email")
    assert rows(weak.select("key", "n_class", "n_links").distinct()) == [("info", 1, n - 1)] and weak.count() == n


def test_weak_classes_count_other_contacts(spark):
    data = [("a", ["+1 415 555 0123", "415 555 0123"]), ("b", ["415 555 0123"]), ("c", ["+44 415 555 0123"]), ("d", ["+44 415 555 0123"]), ("e", ["212 555 0000"]), ("f", ["212 555 0000"])]
    raw = spark.createDataFrame([(c, "N", "", p, [], False) for c, p in data], "contact_id string, given string, family string, phones array<string>, emails array<string>, has_image boolean")
    found = contacts.contact_scan(raw)
    got = rows(contacts.weak_classes(contacts.entries(found), "phone"), "contact_id", "full", "class_id", "n_class", "n_links")
    forms = {c: {k for k in ("+" * p.startswith("+") + "".join(x for x in p if x.isdigit()) for p in ps)} for c, ps in data[:4]}
    want = []
    for c, own in forms.items():
        for f in own:
            same = sorted(x for x in forms if f in forms[x])
            want.append((c, f, same[0], len(same), sum(any(g != f for g in forms[x]) for x in forms if x != c)))
    assert got == sorted(want)


# --- dense hashes ---


def test_dense_hashes_give_links_not_pairs(spark):
    rng = np.random.default_rng(1)
    balls = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]  # all within four bits of each other
    h = rng.choice(np.array(balls, np.uint64), 200_000).view(np.int64)
    df = spark.createDataFrame([("l", f"{i:06}", int(x)) for i, x in enumerate(h)], "library_id string, asset_id string, phash long").repartition(8)
    heads = df.groupBy("library_id", "phash").agg(F.min("asset_id").alias("head"), F.count("*").alias("n"))
    links = near.dense_links(heads, ["library_id"]).where("u <> v")
    assert links.count() < 200_000
    got = near.hash_groups(df, ["library_id"])
    distinct, n = np.unique(h.view(np.uint64), return_counts=True)
    apart = np.bitwise_count(distinct[:, None] ^ distinct[None, :]).astype(np.int64)
    assert apart.max() <= 4
    pairs = len(h) * (len(h) - 1) / 2
    mean = (apart * n[:, None] * n[None, :]).sum() / 2 / pairs
    assert got.count() == 200_000 and rows(got.select("group_id", F.round("confidence", 9)).distinct()) == [("000000", round(1 - mean / 64, 9))]


@pytest.mark.parametrize(("whole", "piece"), [(1024, 512), (1, 512), (1, 4), (20, 7)])
def test_hash_groups_in_one_pass_and_by_pieces(spark, whole, piece):
    rng = random.Random(6)
    data = []
    for s in range(40):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 6))]
        for k in range(rng.randint(1, 30)):
            x = rng.choice(base)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            data.append((None if s == 3 else f"s{s % 20}", f"{s:02}-{k:02}", x - (1 << 64) if x >> 63 else x))
    df = spark.createDataFrame(data, "session string, asset_id string, phash long").repartition(5)
    got = near.hash_groups(df, ["session"], whole=whole, piece=piece)
    edges, apart = [], {}
    for i, (s, a, x) in enumerate(data):
        for t, b, y in data[:i]:
            if s == t and (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= 5:
                edges.append((a, b))
                apart[a, b] = d
    want = []
    for g in groups_of(edges):
        own = [d for (a, _), d in apart.items() if a in g]
        want += [(min(g), a, round(1 - sum(own) / len(own) / 64, 12)) for a in g]
    assert rows(got.select("group_id", "asset_id", F.round("confidence", 12))) == sorted(want)


# --- generations ---


SNAP = "asset_id string, n long"


def test_a_reader_keeps_its_generation(spark, tmp_path):
    path = str(tmp_path / "s")
    assert generations.current(spark, path) is None
    scans.save_snapshot(spark.createDataFrame([("a", 1)], SNAP), path, ["asset_id", "n"])
    open_one = scans.load_snapshot(spark, path, SNAP)
    scans.save_snapshot(spark.createDataFrame([("b", 2)], SNAP), path, ["asset_id", "n"])
    assert rows(open_one) == [("a", 1)] and rows(scans.load_snapshot(spark, path, SNAP)) == [("b", 2)]
    assert generations.expire(spark, path, 3600) == []
    time.sleep(1.1)
    generations.write(spark.createDataFrame([("lost", 3)], SNAP), path)  # of a writer that may still be at work
    assert len(generations.expire(spark, path, 1)) == 1 and rows(scans.load_snapshot(spark, path, SNAP)) == [("b", 2)]
    assert generations.current(spark, path).number == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "s")
    base = scans.save_snapshot(spark.createDataFrame([("a", 1)], SNAP), path, ["asset_id", "n"])
    one, two = (spark.createDataFrame([(x, 1)], SNAP) for x in "xy")
    parts = [generations.write(df, path) for df in (one, two)]
    generations.commit(spark, path, base, {"snapshot": ([parts[0]], one.schema)})
    with pytest.raises(generations.Conflict):
        generations.commit(spark, path, base, {"snapshot": ([parts[1]], two.schema)})
    assert rows(scans.load_snapshot(spark, path, SNAP)) == [("x", 1)] and generations.current(spark, path).number == 2


def test_a_failing_store_is_no_missing_snapshot(spark, tmp_path):
    assert scans.load_snapshot(spark, str(tmp_path / "none"), SNAP).count() == 0
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        scans.load_snapshot(spark, "nostore://x/y", SNAP)
    path = tmp_path / "s"
    scans.save_snapshot(spark.createDataFrame([("a", 1)], SNAP), str(path), ["asset_id", "n"])
    assert scans.load_snapshot(spark, str(path), "asset_id string, other long").count() == 0
    next((path / "generations").glob("0*.json")).write_text("{")
    next((path / "generations").glob(".0*.crc")).unlink()
    with pytest.raises(ValueError):  # a broken manifest does not pass for an empty library either
        scans.load_snapshot(spark, str(path), SNAP)


def test_jobs_in_other_threads_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from sparkclean import storage

    mine = storage.stage(spark.range(3))
    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(storage.staged).result() == []
        other = pool.submit(lambda: (storage.stage(spark.range(5)), storage.staged())).result()
        pool.submit(lambda: storage.drop_staged(spark, storage.staged())).result()
    assert mine.count() == 3 and other[1][0] not in storage.staged()


def test_a_stopped_scan_goes_on(spark, tmp_path, monkeypatch):
    data = [("l", i, T0 + timedelta(seconds=s), 10, 10, n, False, "photo", T0, c) for i, s, n, c in [("a", 0, 3, "abc"), ("b", 1, 3, "abc"), ("c", 2, 5, "x"), ("d", 60, 6, "y")]] + [("l", "v", T0, None, None, 9, False, "video", T0, None)]
    assets = spark.createDataFrame(data, "library_id string, asset_id string, creation_ts timestamp, width int, height int, byte_size long, is_screenshot boolean, media_type string, modification_ts timestamp, content string")
    hashes = spark.createDataFrame([(i, 5) for i in "abcd"], "asset_id string, phash long")
    signals = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1) for i in "abcd"], "asset_id string, resolution double, sharpness double, exposure double, byte_size long")
    path = str(tmp_path / "scan")
    with monkeypatch.context() as m:
        m.setattr(scan, "similar_groups", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            scan.scan_in_phases(path, assets, hashes, signals)
    assert rows(scan.phase_counts(spark, path)) == [("exact", 2, True), ("screenshots", 0, True), ("similar", 0, False), ("videos", 0, False)]
    with monkeypatch.context() as m:
        m.setattr(scan, "exact_duplicates", lambda *a, **k: (_ for _ in ()).throw(AssertionError("done before")))
        found = scan.scan_in_phases(path, assets, hashes, signals)
    assert rows(found["similar"], "asset_id") == [("c",), ("d",)] and rows(found["videos"], "asset_id") == [("v",)]
    assert rows(scan.phase_counts(spark, path)) == [("exact", 2, True), ("screenshots", 0, True), ("similar", 2, True), ("videos", 1, True)]


# --- components that grow ---


def test_growing_components_equal_a_full_run(spark, tmp_path):
    rng = random.Random(7)
    path, known = str(tmp_path / "c"), []
    for batch in range(3):
        edges = [(f"{rng.randint(0, 400):03}", f"{rng.randint(0, 400):03}") for _ in range(120)] + [(f"loop{batch}", f"loop{batch}"), ("x", None)]
        known += edges
        before = generations.current(spark, path)
        df = spark.createDataFrame(edges, "u string, v string")
        after = growing.grow(spark, path, df, batch, 4)
        added = after.tables["links"][-1]
        written = spark.read.parquet(f"{path}/data/{added.folder}").count()
        assert written <= 2 * len(edges) and (not before or after.tables["links"][:-1] == before.tables["links"])
        assert growing.grow(spark, path, df, batch, 4) == after  # a replay
        full = connected_components(spark.createDataFrame(known, "u string, v string"))
        assert rows(growing.components(spark, path)) == rows(full)
    assert growing.compact(spark, path).number == 4 and rows(growing.components(spark, path)) == rows(full)
    growing.grow(spark, path, spark.createDataFrame([("000", "zz"), ("loop0", "zz")], "u string, v string"), 3)
    assert dict(rows(growing.components(spark, path)))["loop0"] == dict(rows(growing.components(spark, path)))["000"]


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    path = str(tmp_path / "c")
    chain = spark.range(0, 3000, 2).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    state = growing.grow(spark, path, chain)
    looked = growing.roots_of(spark, path, state, spark.createDataFrame([(5,), (2001,), (9999,)], "node long"))
    assert rows(looked) == [(5, 4), (2001, 2000), (9999, 9999)]
    assert growing.grow(spark, path, spark.createDataFrame([(5, 2001)], "u long, v long")).tables["links"][-1].files == 1


# --- rescans ---


def asset_rows(spark, data):
    return spark.createDataFrame([(a, T0 + timedelta(seconds=s)) for a, s in data], "asset_id string, modification_ts timestamp")


def test_rescans_can_be_replayed(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "r"), []

    def scan(df):
        seen.append(sorted(r.asset_id for r in df.collect()))
        return df.select("asset_id", F.unix_seconds("modification_ts").alias("s"))

    first = asset_rows(spark, [("a", 1), ("b", 1), ("a", 0)])
    assert streams.rescan_batch(first, 0, path, scan) and not streams.rescan_batch(first, 0, path, scan)
    assert seen == [["a", "b"]]
    second = asset_rows(spark, [("a", 5), ("b", 1), ("c", 2)])
    with monkeypatch.context() as m:  # a crash after everything was written, before the commit
        m.setattr(generations, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            streams.rescan_batch(second, 1, path, scan)
    before = rows(streams.scan_results(spark, path))
    assert len(before) == 2 and streams.rescan_batch(second, 1, path, scan) and not streams.rescan_batch(second, 1, path, scan)
    assert streams.rescan_batch(asset_rows(spark, [("a", 5), ("c", 2)]), 2, path, scan)
    result = rows(streams.scan_results(spark, path))
    assert [a for a, _ in result] == ["a", "a", "b", "c"] and rows(streams.known_assets(spark, path))[0] == ("a", T0 + timedelta(seconds=5))
    assert streams.rescan_batch(first, 0, path, scan, version=2) and len(rows(streams.scan_results(spark, path))) == 2


def test_rescan_stream_scans_each_change_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "DELTAS", 2)
    source, path = tmp_path / "in", str(tmp_path / "r")
    schema = "asset_id string, modification_ts timestamp"
    scan = lambda df: df.select("asset_id")
    for step, data in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("a", 2), ("b", 1)], [("b", 9), ("d", 1)]]):
        asset_rows(spark, data).coalesce(1).write.mode("append").parquet(str(source))
        streams.rescans(spark.readStream.schema(schema).parquet(str(source)), path, scan, str(tmp_path / "check")).awaitTermination()
        assert generations.current(spark, path).marks["batch"] == step
    assert [a for (a,) in rows(streams.scan_results(spark, path))] == ["a", "a", "b", "b", "d"]
    assert len(generations.current(spark, path).tables["known"]) <= 3


# --- bursts that grow ---


def test_growing_bursts_are_revised_until_they_close(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    streams.use_rocksdb(spark)
    schema = "lib string, creation_ts timestamp"

    def feed(*data):
        spark.createDataFrame([(k, T0 + timedelta(seconds=s) if s is not None else None) for k, s in data], schema).coalesce(1).write.mode("append").parquet(str(source))
        found = streams.growing_bursts(spark.readStream.schema(schema).parquet(str(source)), ["lib"], late="5 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        told = spark.read.schema(found.schema).parquet(out)
        return {(r.lib, int((r.session_start - T0).total_seconds()), r.session_size, r.state, r.revision) for r in streams.latest_bursts(told, ["lib"]).collect()}

    now = feed(("a", 0), ("a", 120), ("a", 241), ("b", 10), ("a", None))
    assert now == {("a", 0, 2, "open", 1)}  # a gap of 121 seconds splits; a single row is no burst yet
    now = feed(("a", 300), ("b", 100), ("b", 400), ("b", 410))
    assert now == {("a", 0, 2, "open", 1), ("a", 241, 2, "open", 1), ("b", 10, 2, "open", 1), ("b", 400, 2, "open", 1)}
    now = feed(("a", 180))  # a late row joins two bursts
    assert now == {("a", 0, 5, "open", 2), ("b", 10, 2, "open", 1), ("b", 400, 2, "open", 1)}
    now = feed(("c", 2000))
    now = feed(("c", 2001))
    assert {x[:4] for x in now} == {("a", 0, 5, "closed"), ("b", 10, 2, "closed"), ("b", 400, 2, "closed"), ("c", 2000, 2, "open")}


def test_growing_bursts_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(8)
    streams.use_rocksdb(spark)
    schema, source, out = "lib string, creation_ts timestamp", tmp_path / "in", str(tmp_path / "out")
    data, at = [], 0
    for _ in range(400):
        at += rng.choice([1, 30, 119, 120, 121, 500])
        data.append((rng.choice("ab"), T0 + timedelta(seconds=max(0, at - rng.choice([0, 0, 0, 100, 400])))))
    for k in range(0, 400, 200):
        spark.createDataFrame(data[k : k + 200], schema).coalesce(1).write.mode("append").parquet(str(source))
        found = streams.growing_bursts(spark.readStream.schema(schema).parquet(str(source)), ["lib"])
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        want = sessions.sessions_of_two(spark.createDataFrame(data[: k + 200], schema), "creation_ts", ["lib"]).select("lib", "session_start", "session_size").distinct()
        standing = streams.latest_bursts(spark.read.schema(found.schema).parquet(out), ["lib"])
        assert rows(standing, "lib", "session_start", "session_size") == rows(want)


# --- selection ---


def test_streamed_selection_equals_the_replay_of_each_prefix(spark, tmp_path):
    rng = random.Random(11)
    streams.use_rocksdb(spark)
    schema, source, out = "seq long, group_id string, item_id string, op string", tmp_path / "in", str(tmp_path / "out")
    groups = spark.createDataFrame([(f"g{i}", ["a", "b", None][i % 3]) for i in range(6)], "group_id string, recommended_keep string")
    members = groups.crossJoin(spark.createDataFrame([(x,) for x in "abcd"], "asset_id string")).select("group_id", "asset_id")
    log = []
    for seq in range(180):
        op = rng.choice(["toggle", "toggle", "toggle", "set_keep", "select_all", "deselect_all"])
        log.append((seq, f"g{rng.randint(0, 5)}", rng.choice("abcde") if op in ("toggle", "set_keep") else None, op))
    for k in range(0, 180, 60):
        spark.createDataFrame(rng.sample(log[k : k + 60], 60), schema).coalesce(1).write.mode("append").parquet(str(source))
        found = streams.selection_changes(spark.readStream.schema(schema).parquet(str(source)), members, groups)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        want = review.replay(spark.createDataFrame(log[: k + 60], schema), members, groups)
        assert rows(streams.standing_selection(spark.read.schema(found.schema).parquet(out), members)) == rows(want, "group_id", "asset_id", "selected")


# --- contents and files ---


def test_chunk_hashes(spark):
    rng = random.Random(9)
    contents = {f"a{i}": rng.randbytes(rng.choice([0, 1, 10, 5000])) for i in range(30)}
    chunks = [(k, p, c[p * 7 : p * 7 + 7]) for k, c in contents.items() for p in range(max(1, -(-len(c) // 7)))] + [("none", 0, None), ("some", 0, b"x"), ("some", 1, None), ("some", 2, b"y")]
    rng.shuffle(chunks)
    got = rows(scans.chunk_hashes(spark.createDataFrame(chunks, "asset_id string, pos long, chunk binary").repartition(6)).fillna("-", ["content_hash"]))
    want = [(k, hashlib.sha256(c).hexdigest(), len(c)) for k, c in contents.items()] + [("none", "-", 0), ("some", hashlib.sha256(b"xy").hexdigest(), 2)]
    assert got == sorted(want)
    assert scans.chunk_hashes(spark.createDataFrame([], "asset_id string, pos long, chunk binary")).count() == 0


def test_file_sizes_do_not_read_contents(spark, tmp_path):
    for name, text in {"a.bin": "x" * 10, "empty.bin": "", "sub/c.txt": "yy"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = scans.file_sizes(spark, str(tmp_path)).select("item", "byte_size")
    assert rows(found) == [("a.bin", 10), ("sub/c.txt", 2)]
    assert "content" not in plan_of(found).split("ReadSchema")[1]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    big = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(big) + "\n")
    (tmp_path / "small.txt").write_text("one\r\ntwo\rthree\n\nfive")
    (tmp_path / "empty.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = scans.numbered_lines(spark, str(tmp_path))
        got = rows(lines)
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("big.txt", i + 1, x) for i, x in enumerate(big)] + [("small.txt", i + 1, x) for i, x in enumerate(["one", "two", "three", "", "five"])])


def test_grey_cells_need_no_shuffle(spark):
    rng = random.Random(10)
    made = [[[rng.randint(0, 255) for _ in range(w)] for _ in range(h)] for w, h in [(9, 8), (23, 17), (8, 8), (9, 7), (40, 31)]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)] + [(9, None), (10, [])], "i long, m array<array<int>>")
    cells = df.select("i", images.grey_cells(F.col("m"), 9, 8).alias("g"))
    pixels = df.select(F.col("i").cast("string").alias("asset_id"), F.posexplode("m").alias("y", "row")).select("asset_id", "y", F.posexplode("row").alias("x", "luma"))
    want = {int(a): g for a, g in rows(near.grey_grid(pixels, 9, 8))}
    assert {r.i: r.g for r in cells.collect() if r.g is not None} == want and set(want) == {0, 1, 4}
    assert "Exchange" not in plan_of(cells)


def test_name_scores_agree_with_the_join(spark):
    pairs = [("Information Desk Berlin 1", "Information Desk Berlin 2"), ("Smith, John Alexander", "John Alexander Smith"), ("Abcdefghi", "Abcdefghj")]
    raw = [(f"{i}{s}", name, "", [], [f"x{i}@{s}.example"], False) for i, pair in enumerate(pairs) for s, name in zip("ab", pair)]
    found = contacts.contact_scan(spark.createDataFrame(raw, "contact_id string, given string, family string, phones array<string>, emails array<string>, has_image boolean"))
    scored = [spark.range(1).select(keys.name_score(F.lit(a), F.lit(b))).first()[0] >= 0.9 for a, b in pairs]
    letters = [a[0].lower() == b[0].lower() for a, b in pairs]
    want = [(f"{i}a", f"{i}b") for i in range(3) if scored[i] and letters[i]]
    assert rows(contacts.name_links(found, contacts.entries(found)), "u", "v") == want and want == [("0a", "0b")]


def test_hashes_that_pack_well_are_not_taken_for_a_small_side(spark):
    """60,000 hashes are less than 1 MB in files; as 21 rows each they must not be collected by the driver."""
    hashed = spark.range(60_000).select(F.lit("all").alias("library_id"), F.lpad(F.col("id").cast("string"), 12, "0").alias("asset_id"), F.xxhash64("id").alias("phash"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = near.similar_pairs(hashed, ["library_id"])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hashes_of_odd_texts_are_counted_in_one_pass(spark, tmp_path):
    texts = ["", None, " \t\n", "one", "One  TWO\tthree\r\nfour\n\n", "x y z\x0bz", "İΣ Σa", " ".join(f"w{i % 37}" for i in range(500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(text):
        cells = [0] * 72
        for word in re.split(r"[ \t\n\r]+", text):
            if word:
                cells[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 72] += 1
        bits = sum(1 << (8 * r + c) for r in range(8) for c in range(8) if cells[9 * r + c] < cells[9 * r + c + 1])
        return bits - (1 << 64) if bits >> 63 else bits

    lower = [r.t for r in spark.read.parquet(f"{tmp_path}/documents.parquet").orderBy("doc_id").select(F.lower("text").alias("t")).collect()]
    found = views.hashes(spark, str(tmp_path))
    assert rows(found) == [(str(i).zfill(12), plain(t)) for i, t in enumerate(lower) if t and re.sub(r"[ \t\n\r]", "", t)]
    assert "replace(" not in plan_of(found)


def test_texts_are_read_once_for_hashes_and_signals(spark):
    data = "/root/testdata/sf0.001"
    assert "documents.parquet" not in plan_of(queries.QUERIES["s6_is_similar"](spark, data)) and "regexp_replace" not in plan_of(queries.QUERIES["c2_weighted_score"](spark, data))
