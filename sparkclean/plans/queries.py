"""The registered queries, one for each operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, keys
from ..operators import audit, cleanup, contacts, exact, growing, near, review, scoring, sessions
from ..operators.components import connected_components
from ..sources import scans
from ..storage import shared_folder, stage, table
from ..streaming import streams
from . import scan
from . import views as v
from .views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def seconds(name: str) -> Column:
    return F.coalesce(F.unix_seconds(name), F.lit(-1)).alias("creation_s")


def ids(spark: SparkSession, d: str, fold: int) -> DataFrame:
    return v.assets(spark, d).where(F.col("doc_id") % fold == 0).select("asset_id")


def not_in(spark: SparkSession, d: str, fold: int) -> DataFrame:
    return v.assets(spark, d).where(F.col("doc_id") % fold != 0).select("asset_id")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return contacts.contact_scan(v.contacts_raw(spark, d))


# --- sources, sinks, lookups ---


@query("a1_asset_scan", sql("assets", "SELECT library_id, asset_id, coalesce(creation_s, -1) AS creation_s, width, height FROM assets"))
def a1(spark, d):
    return scans.assets_of_type(v.assets(spark, d), "photo", ["library_id", "asset_id", "creation_ts", "width", "height"]).select("library_id", "asset_id", seconds("creation_ts"), "width", "height")


@query("a2_video_scan", sql("videos", "SELECT asset_id, coalesce(creation_s, -1) AS creation_s, duration_s, byte_size FROM videos"))
def a2(spark, d):
    return scans.assets_of_type(v.videos(spark, d), "video", ["asset_id", "creation_ts", "duration_s", "byte_size"]).select("asset_id", seconds("creation_ts"), "duration_s", "byte_size")


@query("a3_contact_scan", sql("contacts", "SELECT contact_id, given, family, phone AS phones, coalesce(email, '') AS emails, field_count FROM contacts"))
def a3(spark, d):
    return customers(spark, d).select("contact_id", "given", "family", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), "field_count")


@query("a4_byte_size", sql("assets", "SELECT asset_id, byte_size FROM assets"))
def a4(spark, d):
    partly = v.assets(spark, d).withColumn("byte_size", F.when(F.col("doc_id") % 5 != 0, F.col("byte_size")))
    return scans.with_byte_size(partly).select("asset_id", "byte_size")


_RESOURCES = """SELECT asset_id, ['fullSizeVideo', 'thumb', 'video', 'photo', 'audio', 'fullSizePhoto'][CAST((doc_id * 7 + pos * 5) % 6 AS INT) + 1] AS resource_type, pos FROM assets, (SELECT unnest(range(3)) AS pos)"""


@query("a5_primary_resource", sql("assets", """SELECT asset_id, resource_type, pos FROM r QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY
 CASE resource_type WHEN 'photo' THEN 0 WHEN 'fullSizePhoto' THEN 1 WHEN 'video' THEN 2 WHEN 'fullSizeVideo' THEN 3 ELSE 4 END, pos) = 1""", r=_RESOURCES))
def a5(spark, d):
    rows = v.assets(spark, d).select("asset_id", "doc_id", F.explode(F.expr("sequence(0L, 2L)")).alias("pos"))
    kind = F.expr("array('fullSizeVideo', 'thumb', 'video', 'photo', 'audio', 'fullSizePhoto')[cast((doc_id * 7 + pos * 5) % 6 as int)]")
    return scans.primary_resources(rows.select("asset_id", kind.alias("resource_type"), "pos"))


@query("a6_content_hash", sql("assets", "SELECT asset_id, sha256(content) AS content_hash FROM assets"))
def a6(spark, d):
    return scans.content_hashes(v.assets(spark, d))


@query("a6_chunk_hash", sql("assets", "SELECT asset_id, sha256(content) AS content_hash, byte_size FROM assets"))
def a6_chunks(spark, d):
    """The same digests from chunks of 1,000 bytes."""
    content = v.assets(spark, d).select("asset_id", F.encode("content", "UTF-8").alias("content"))
    last = F.floor(F.greatest(F.octet_length("content") - 1, F.lit(0)) / 1000).cast("int")
    chunks = content.select("asset_id", "content", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return scans.chunk_hashes(chunks.select("asset_id", "pos", F.substring("content", F.col("pos") * 1000 + 1, F.lit(1000)).alias("chunk")))


@query("a7_assets_still_there", sql("assets", "SELECT asset_id FROM assets WHERE doc_id % 5 = 0 AND doc_id % 11 <> 0"))
def a7(spark, d):
    return scans.still_there(ids(spark, d, 5), not_in(spark, d, 11), "asset_id")


@query("a8_contacts_still_there", sql("contacts_raw", "SELECT contact_id FROM contacts_raw WHERE k % 5 = 0 AND k % 11 <> 0"))
def a8(spark, d):
    raw = v.contacts_raw(spark, d)
    return scans.still_there(raw.where("k % 5 = 0").select("contact_id"), raw.where("k % 11 <> 0"), "contact_id")


@query("a9_display_fields", sql("contacts_raw", "SELECT a.contact_id, b.given, b.family, b.contact_id IS NULL AS is_stale FROM contacts_raw a LEFT JOIN (SELECT * FROM contacts_raw WHERE k % 11 <> 0) b USING (contact_id) WHERE a.k % 5 = 0"))
def a9(spark, d):
    raw = v.contacts_raw(spark, d)
    return scans.display_fields(raw.where("k % 5 = 0").select("contact_id"), raw.where("k % 11 <> 0").select("contact_id", "given", "family"))


@query("a10_a11_snapshot", sql("assets", "SELECT asset_id, byte_size FROM assets"))
def a10(spark, d):
    path = f"{shared_folder(spark)}/snapshot-{spark.range(1).select(F.uuid()).first()[0]}"
    scans.save_snapshot(v.assets(spark, d), path, ["asset_id", "byte_size"])
    return scans.load_snapshot(spark, path, "asset_id string, byte_size long")


@query("a11_other_version", sql("assets", "SELECT asset_id, byte_size FROM assets WHERE false"))
def a11(spark, d):
    path = f"{shared_folder(spark)}/snapshot-{spark.range(1).select(F.uuid()).first()[0]}"
    scans.save_snapshot(v.assets(spark, d), path, ["asset_id", "byte_size"], version=scans.SCHEMA_VERSION + 1)
    return scans.load_snapshot(spark, path, "asset_id string, byte_size long")


@query("a11_missing_snapshot", sql("assets", "SELECT asset_id, false AS stored FROM assets"))
def a11_missing(spark, d):
    """Without a snapshot every asset is new."""
    snapshot = scans.load_snapshot(spark, f"{shared_folder(spark)}/no-snapshot-here", "asset_id string, byte_size long")
    return v.assets(spark, d).select("asset_id").join(snapshot.select("asset_id", F.lit(True).alias("s")), "asset_id", "left").select("asset_id", F.coalesce("s", F.lit(False)).alias("stored"))


@query("a12_replaced_snapshot", sql("assets", "SELECT asset_id FROM assets WHERE doc_id % 3 = 0"))
def a12(spark, d):
    """A snapshot is replaced by the next one."""
    path, rows = f"{shared_folder(spark)}/snapshot-{spark.range(1).select(F.uuid()).first()[0]}", v.assets(spark, d)
    scans.save_snapshot(rows, path, ["asset_id"])
    scans.save_snapshot(scans.load_snapshot(spark, path, "asset_id string").where(F.col("asset_id").cast("long") % 3 == 0), path, ["asset_id"])
    return scans.load_snapshot(spark, path, "asset_id string")


@query("a13_delete_assets", sql("assets", "SELECT asset_id, doc_id % 5 = 0 AS deleted FROM assets WHERE doc_id % 11 <> 0"))
def a13(spark, d):
    rest, confirmed = scans.apply_deletes(not_in(spark, d, 11), ids(spark, d, 5))
    return rest.withColumn("deleted", F.lit(False)).unionByName(confirmed.withColumn("deleted", F.lit(True)))


@query("a14_delete_contacts", sql("contacts_raw", "SELECT contact_id, k % 5 = 0 AS deleted FROM contacts_raw WHERE k % 11 <> 0"))
def a14(spark, d):
    raw = v.contacts_raw(spark, d)
    rest, confirmed = scans.apply_deletes(raw.where("k % 11 <> 0").select("contact_id"), raw.where("k % 5 = 0").select("contact_id"), "contact_id")
    return rest.withColumn("deleted", F.lit(False)).unionByName(confirmed.withColumn("deleted", F.lit(True)))


_LINES = """SELECT 'd' || CAST(doc_id AS VARCHAR) AS item, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS lineno FROM documents
 UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), unnest(string_split(html, chr(10))), generate_subscripts(string_split(html, chr(10)), 1) FROM pages"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item"), "text")
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("item"), F.col("html").alias("text"))
    return audit.text_lines(docs.unionByName(pages))


@query("a15_text_lines", f"WITH lines AS ({_LINES}) SELECT item, lineno, length(line) AS n FROM lines")
def a15(spark, d):
    return lines(spark, d).select("item", "lineno", F.length("line").alias("n"))


@query("a4_a15_files", """SELECT lang, count(*) AS n_lines, count(*) AS last_numbers, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes
 FROM (SELECT lang, unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents) GROUP BY 1""")
def a4_files(spark, d):
    """All lines of the documents as text files by language: their sizes from the file system, their lines numbered over splits."""
    path = f"{shared_folder(spark)}/files-{spark.range(1).select(F.uuid()).first()[0]}"
    every = table(spark, d, "documents").select("lang", F.explode(F.split(F.translate("text", "\r", " "), "\n")).alias("line"))
    every.write.partitionBy("lang").text(path)
    lang = F.regexp_extract("item", "^lang=([^/]*)/", 1).alias("lang")
    sizes = scans.file_sizes(spark, path).groupBy(lang).agg(F.sum("byte_size").alias("n_bytes"))
    files = scans.numbered_lines(spark, path).groupBy("item").agg(F.count("*").alias("n"), F.max("lineno").alias("last"), F.sum(F.length("line")).alias("chars"))
    found = files.groupBy(lang).agg(F.sum("n").alias("n_lines"), F.sum("last").alias("last_numbers"), F.sum("chars").alias("n_chars"))
    return found.join(sizes, "lang")


# --- filters, projections, exclusions ---


@query("b1_screenshots", sql("assets", "SELECT asset_id FROM assets WHERE is_screenshot"))
def b1(spark, d):
    return scans.screenshots(v.assets(spark, d)).select("asset_id")


@query("b2_sizes_or_zero", sql("videos", "SELECT asset_id, duration_s, CASE WHEN k % 9 = 0 THEN 0 ELSE byte_size END AS byte_size FROM videos"))
def b2(spark, d):
    rows = v.videos(spark, d)
    return scans.sizes_or_zero(rows.select("asset_id", "duration_s", "byte_size"), rows.where("k % 9 <> 0"))


@query("b4_similarity_candidates", sql("candidates", "SELECT asset_id FROM candidates"))
def b4(spark, d):
    return near.similarity_candidates(v.assets(spark, d)).select("asset_id")


@query("b5_without_exact_members", sql("candidates exact_members", "SELECT asset_id FROM candidates WHERE asset_id NOT IN (SELECT asset_id FROM exact_members)"))
def b5(spark, d):
    rows = v.assets(spark, d)
    return near.similarity_candidates(rows, exact.exact_duplicates(rows)).select("asset_id")


@query("b6_readable_grids", sql("vectors", "SELECT asset_id FROM (SELECT DISTINCT asset_id FROM vectors) WHERE CAST(asset_id AS BIGINT) % 10 <> 0"))
def b6(spark, d):
    grid = F.transform("grid", lambda r: F.concat(r, F.array(F.get(r, 0))))
    broken = F.when(F.col("asset_id").cast("long") % 10 == 0, F.slice(grid, 1, 7)).otherwise(grid)
    return v.vector_grids(spark, d).select("asset_id", images.dhash(broken).alias("phash")).where("phash is not null").select("asset_id")


@query("b7_access_scope", sql("assets", "SELECT asset_id, true AS scanned_with_limited_access FROM assets WHERE doc_id % 4 = 0"))
def b7(spark, d):
    rows = v.assets(spark, d)
    return scans.in_scope(rows, rows.where("doc_id % 4 = 0")).select("asset_id", "scanned_with_limited_access")


@query("b8_exact_tier", sql("contact_groups", "SELECT group_id, n_members FROM contact_groups WHERE tier = 'exact'"))
def b8(spark, d):
    groups, _ = contacts.link_contacts(stage(customers(spark, d)))
    return review.tier_groups(groups, "exact").select("group_id", "n_members")


@query("b9_selected_members", sql("members", "SELECT group_id, asset_id, byte_size, recommended_keep, user_keep FROM members JOIN groups USING (group_id) WHERE selected"))
def b9(spark, d):
    groups, members = v.reviewed(spark, d)
    return review.selected_members(members, groups).select("group_id", "asset_id", "byte_size", "recommended_keep", "user_keep")


@query("b10_primary_split", sql("contact_groups", "SELECT group_id, contact_id, contact_id = recommended_primary AS is_primary FROM contact_members JOIN contact_groups USING (group_id)"))
def b10(spark, d):
    groups, members = contacts.link_contacts(stage(customers(spark, d)))
    return review.primary_split(members, groups).select("group_id", "contact_id", "is_primary")


# --- exact duplicates ---


@query("e1_dimension_buckets", sql("assets", "SELECT asset_id FROM assets QUALIFY count(*) OVER (PARTITION BY library_id, width, doc_id % 97) > 1"))
def e1(spark, d):
    return exact.dimension_buckets(v.assets(spark, d).withColumn("height", F.col("doc_id") % 97)).select("asset_id")


@query("e2_size_buckets", sql("assets", "SELECT asset_id, byte_size FROM assets QUALIFY count(*) OVER (PARTITION BY library_id, width, height, byte_size) > 1"))
def e2(spark, d):
    rows = v.assets(spark, d)
    return exact.size_buckets(exact.dimension_buckets(rows.drop("content")), rows).select("asset_id", "byte_size")


@query("e3_digest_groups", sql("assets", "SELECT asset_id, sha256(content) AS digest FROM assets QUALIFY count(*) OVER (PARTITION BY library_id, width, height, byte_size, sha256(content)) > 1"))
def e3(spark, d):
    rows = v.assets(spark, d)
    return exact.digest_groups(exact.size_buckets(exact.dimension_buckets(rows.drop("content")), rows), rows).select("asset_id", "digest")


@query("e4_exact_duplicates", sql("exact_members", "SELECT group_id, asset_id, digest FROM exact_members"))
def e4(spark, d):
    return exact.exact_duplicates(v.assets(spark, d)).select("group_id", "asset_id", "digest")


@query("e5_earliest_keep", sql("exact_members", "SELECT DISTINCT group_id, recommended_keep FROM exact_members"))
def e5(spark, d):
    return exact.exact_duplicates(v.assets(spark, d)).select("group_id", "recommended_keep").distinct()


@query("e6_member_sizes", sql("exact_members", "SELECT group_id, CAST(sum(byte_size) AS BIGINT) AS bytes, CAST(1.0 AS DOUBLE) AS confidence, 'exactDuplicate' AS kind FROM exact_members GROUP BY 1"))
def e6(spark, d):
    return exact.exact_duplicates(v.assets(spark, d)).groupBy("group_id").agg(F.sum("byte_size").alias("bytes"), F.max("confidence").alias("confidence"), F.max("kind").alias("kind"))


@query("e0_size_errors", sql("assets", "SELECT asset_id, 'size unavailable' AS error FROM assets WHERE doc_id % 9 = 0"))
def e0(spark, d):
    return exact.size_errors(v.assets(spark, d).withColumn("byte_size", F.when(F.col("doc_id") % 9 != 0, F.col("byte_size"))))


# --- near duplicates ---

_GAPS = """SELECT *, sum(new) OVER ({p} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER ({p} ORDER BY ts, event_id) <= INTERVAL {g} SECOND THEN 0 ELSE 1 END AS new FROM events)"""


@query("s1_gap_sessions", f"""SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS session_size FROM ({_GAPS.format(p='PARTITION BY user_id', g=3600)}) GROUP BY user_id, s HAVING count(*) > 1""")
def s1(spark, d):
    found = sessions.sessions_of_two(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], 3600)
    return found.groupBy("user_id", F.unix_micros("session_start").alias("start_us")).agg(F.max("session_size").alias("session_size"))


@query("s2_global_sessions", f"""SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS session_size FROM ({_GAPS.format(p='', g=120)}) GROUP BY s""")
def s2(spark, d):
    found = sessions.gap_sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return found.groupBy(F.unix_micros("session_start").alias("start_us")).agg(F.max("session_size").alias("session_size"))


@query("s3_grey_grid", sql("vectors", "SELECT asset_id, y // 2 AS row_no, x // 2 AS col_no, CAST(round(avg(v)) AS BIGINT) AS luma FROM vectors GROUP BY 1, 2, 3"))
def s3(spark, d):
    grids = v.vector_grids(spark, d).select("asset_id", images.grey_cells(F.col("grid"), 4, 4).alias("grid"))
    return grids.select("asset_id", F.posexplode("grid").alias("row_no", "cells")).select("asset_id", "row_no", F.posexplode("cells").alias("col_no", "luma"))


@query("s4_difference_hash", sql("hashes", "SELECT asset_id, phash FROM hashes"))
def s4(spark, d):
    return v.hashes(spark, d)


def _neighbours(spark, d):
    own = stage(v.hashes(spark, d).select(F.col("asset_id").cast("long").alias("n"), F.col("phash").alias("a")), "hashes")  # read for both sides
    return own.join(own.select((F.col("n") - 1).alias("n"), F.col("a").alias("b")), "n")


_NEXT = "SELECT CAST(a.asset_id AS BIGINT) AS n, bit_count(xor(a.phash, b.phash)) AS distance FROM hashes a JOIN hashes b ON CAST(b.asset_id AS BIGINT) = CAST(a.asset_id AS BIGINT) + 1"


@query("s5_hamming_distance", sql("hashes", _NEXT))
def s5(spark, d):
    return _neighbours(spark, d).select("n", images.hamming(F.col("a"), F.col("b")).alias("distance"))


@query("s6_is_similar", sql("hashes", f"SELECT n, distance <= 25 AS similar FROM ({_NEXT})"))
def s6(spark, d):
    return _neighbours(spark, d).select("n", images.is_similar(F.col("a"), F.col("b"), 25).alias("similar"))


_PAIRS = "SELECT a.asset_id AS left_id, b.asset_id AS right_id, bit_count(xor(a.phash, b.phash)) AS distance FROM hashes a JOIN hashes b ON a.asset_id < b.asset_id AND bit_count(xor(a.phash, b.phash)) <= 5"
_REACH = "SELECT left_id AS node, left_id AS other FROM pairs UNION SELECT right_id, right_id FROM pairs UNION SELECT r.node, CASE WHEN p.left_id = r.other THEN p.right_id ELSE p.left_id END FROM reach r JOIN pairs p ON p.left_id = r.other OR p.right_id = r.other"
_COMPONENTS = "SELECT node AS asset_id, min(other) AS group_id FROM reach GROUP BY 1"


def _hashed(spark, d):
    return stage(v.hashes(spark, d).withColumn("library_id", F.lit("all")))


_HEADS = "SELECT phash, min(asset_id) AS head FROM hashes GROUP BY 1"


@query("s7_close_pairs", sql("hashes", """SELECT least(a.head, b.head) AS left_id, greatest(a.head, b.head) AS right_id, bit_count(xor(a.phash, b.phash)) AS distance FROM heads a JOIN heads b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 5
 UNION ALL SELECT head, asset_id, 0 FROM hashes JOIN heads USING (phash) WHERE asset_id <> head""", heads=_HEADS))
def s7(spark, d):
    return near.similar_pairs(_hashed(spark, d), ["library_id"])


@query("s8_components", sql("hashes", "SELECT * FROM components", pairs=_PAIRS, reach=_REACH, components=_COMPONENTS))
def s8(spark, d):
    found = connected_components(near.similar_pairs(_hashed(spark, d), ["library_id"]).select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    return found.select(F.col("node").alias("asset_id"), F.col("component").alias("group_id"))


@query("s8_growing_components", sql("hashes", "SELECT * FROM components", pairs=_PAIRS, reach=_REACH, components=_COMPONENTS))
def s8_growing(spark, d):
    """The same components from three batches of edges, the second of which is given twice."""
    pairs = near.similar_pairs(_hashed(spark, d), ["library_id"]).select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))
    pairs = stage(pairs, "pairs")
    path = f"{shared_folder(spark)}/components-{spark.range(1).select(F.uuid()).first()[0]}"
    for batch in (0, 1, 1, 2):
        growing.grow(spark, path, pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(3)) == batch), batch)
    return growing.components(spark, path).select(F.col("node").alias("asset_id"), F.col("component").alias("group_id"))


@query("s9_group_confidence", sql("hashes", "SELECT group_id, round(1 - avg(distance) / 64, 9) AS confidence FROM pairs JOIN components ON left_id = asset_id GROUP BY 1", pairs=_PAIRS, reach=_REACH, components=_COMPONENTS))
def s9(spark, d):
    return near.hash_groups(_hashed(spark, d), ["library_id"]).select("group_id", F.round("confidence", 9).alias("confidence")).distinct()


_BUCKET_PAIRS = """SELECT a.asset_id AS left_id, b.asset_id AS right_id, bit_count(xor(a.phash, b.phash)) AS distance FROM h a JOIN h b ON a.library_id = b.library_id AND a.session_no = b.session_no AND a.asset_id < b.asset_id
 AND bit_count(xor(a.phash, b.phash)) <= 5"""
_BUCKET = {"h": "SELECT s.*, phash FROM sessions s JOIN hashes USING (asset_id) WHERE s.n > 1", "pairs": _BUCKET_PAIRS, "reach": _REACH, "components": _COMPONENTS,
           "judged": """SELECT c.group_id, c.asset_id, s.resolution / max(s.resolution) OVER w AS r, s.sharpness / max(s.sharpness) OVER w AS p, s.exposure / max(s.exposure) OVER w AS e, s.byte_size / max(s.byte_size) OVER w AS b FROM components c JOIN signals s USING (asset_id) WINDOW w AS (PARTITION BY c.group_id)""",
           "totals": "SELECT *, r * 0.35 + p * 0.45 + e * 0.15 + b * 0.05 AS total FROM judged"}


def _similar(spark, d):
    rows = v.assets(spark, d)
    return near.similar_groups(rows, v.hashes(spark, d), lambda members: v.signals(spark, d, members).drop("group_id"), stage(exact.exact_duplicates(rows)))


@query("s10_similar_groups", sql("sessions hashes signals", "SELECT group_id, asset_id, round(total, 9) AS total, first_value(asset_id) OVER (PARTITION BY group_id ORDER BY total DESC, asset_id) AS recommended_keep FROM totals", **_BUCKET))
def s10(spark, d):
    return _similar(spark, d).select("group_id", "asset_id", F.round("total", 9).alias("total"), "recommended_keep")


@query("c5_similar_group_rows", sql("sessions hashes signals", "SELECT c.group_id, count(DISTINCT c.asset_id) AS n, 'similar' AS kind, round(1 - avg(distance) / 64, 9) AS confidence FROM components c JOIN pairs ON left_id IN (SELECT asset_id FROM components x WHERE x.group_id = c.group_id) GROUP BY 1", **_BUCKET))
def c5(spark, d):
    return _similar(spark, d).groupBy("group_id", "kind").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 9).alias("confidence"))


@query("scan_phases", sql("sessions hashes signals videos", """SELECT 'screenshots' AS phase, count(*) AS n_items, true AS done FROM assets WHERE is_screenshot UNION ALL SELECT 'exact', count(*), true FROM exact_members
 UNION ALL SELECT 'similar', count(*), true FROM components UNION ALL SELECT 'videos', count(*), true FROM videos""", **_BUCKET))
def scan_phases(spark, d):
    """The whole scan of photos and videos, its phases committed one by one, and what each has found."""
    photos = v.assets(spark, d).drop("doc_id")
    whole = photos.unionByName(v.videos(spark, d).drop("k", "duration_s"), allowMissingColumns=True)
    path = f"{shared_folder(spark)}/scan-{spark.range(1).select(F.uuid()).first()[0]}"
    scan.scan_in_phases(path, whole, v.hashes(spark, d), lambda members: v.signals(spark, d, members).drop("group_id"))
    return scan.phase_counts(spark, path)


# --- quality signals and keep choice ---

_LAPLACE = """SELECT c.asset_id, CAST(u.v + w.v + l.v + r.v - 4 * c.v AS DOUBLE) AS x FROM vectors c JOIN vectors u ON u.asset_id = c.asset_id AND u.x = c.x AND u.y = c.y - 1 JOIN vectors w ON w.asset_id = c.asset_id AND w.x = c.x AND w.y = c.y + 1
 JOIN vectors l ON l.asset_id = c.asset_id AND l.y = c.y AND l.x = c.x - 1 JOIN vectors r ON r.asset_id = c.asset_id AND r.y = c.y AND r.x = c.x + 1"""


@query("c0a_sharpness", sql("vectors", "SELECT asset_id, round(var_pop(x), 6) AS sharpness FROM laplace GROUP BY 1", laplace=_LAPLACE))
def c0a(spark, d):
    return v.vector_grids(spark, d).select("asset_id", F.round(images.laplacian_variance(F.col("grid")), 6).alias("sharpness"))


@query("c0b_exposure", sql("vectors", "SELECT asset_id, 1 - sum(CAST(v < 90 OR v > 165 AS INT)) / 64 AS exposure FROM vectors GROUP BY 1"))
def c0b(spark, d):
    return v.vector_grids(spark, d).select("asset_id", images.exposure_score(F.col("grid"), 90, 165).alias("exposure"))


@query("c0d_resolution", sql("assets", "SELECT asset_id, CAST(width * height AS DOUBLE) AS resolution FROM assets"))
def c0d(spark, d):
    return v.assets(spark, d).select("asset_id", images.resolution(F.col("width"), F.col("height")).alias("resolution"))


_SCORES = """SELECT *, count(*) OVER w AS group_size, resolution / max(resolution) OVER w AS r, sharpness / max(sharpness) OVER w AS p, CASE WHEN max(exposure) OVER w > 0 THEN exposure / max(exposure) OVER w ELSE 0 END AS e, byte_size / max(byte_size) OVER w AS b FROM signals WINDOW w AS (PARTITION BY group_id)"""
_TOTALS = "SELECT *, r * 0.35 + p * 0.45 + e * 0.15 + b * 0.05 AS total FROM scores"


@query("c1_normalized_signals", sql("signals", "SELECT asset_id, round(r, 9) AS r, round(p, 9) AS p, round(e, 9) AS e, round(b, 9) AS b FROM scores", scores=_SCORES))
def c1(spark, d):
    return scoring.normalized(stage(v.signals(spark, d), "signals")).select("asset_id", *[F.round(f"{s}_score", 9).alias(n) for s, n in zip(scoring.WEIGHTS, "rpeb")])


@query("c2_weighted_score", sql("signals", "SELECT asset_id, round(total, 9) AS total FROM totals", scores=_SCORES, totals=_TOTALS))
def c2(spark, d):
    return scoring.weighted(stage(v.signals(spark, d), "signals")).select("asset_id", F.round("total", 9).alias("total"))


@query("c3_recommended_keep", sql("signals", "SELECT DISTINCT group_id, first_value(asset_id) OVER (PARTITION BY group_id ORDER BY total DESC, asset_id) AS recommended_keep FROM totals", scores=_SCORES, totals=_TOTALS))
def c3(spark, d):
    return scoring.scored(scoring.weighted(stage(v.signals(spark, d), "signals"))).select("group_id", "recommended_keep").distinct()


@query("c4_reason", sql("signals", """SELECT asset_id, CASE WHEN total < max(total) OVER (PARTITION BY group_id) THEN 'Lower overall quality than the recommended photo in this group of ' || group_size || '.'
 WHEN r >= 0.99 AND p >= 0.99 THEN 'Highest resolution, sharpest of ' || group_size || '.' WHEN r >= 0.99 THEN 'Highest resolution of ' || group_size || '.' WHEN p >= 0.99 THEN 'Sharpest of ' || group_size || '.'
 WHEN e >= 0.99 THEN 'Best exposed of ' || group_size || '.' ELSE 'Best overall balance of resolution and sharpness of ' || group_size || '.' END AS reason FROM totals""", scores=_SCORES, totals=_TOTALS))
def c4(spark, d):
    return scoring.scored(scoring.weighted(stage(v.signals(spark, d), "signals"))).select("asset_id", "reason")


# --- contact linkage ---


def _phones(spark, d):
    return v.contacts_raw(spark, d).select("contact_id", "k", F.get("phones", 0).alias("raw")).withColumn("phone", keys.normalize_phone(F.col("raw")))


@query("d1_phone_normal_form", sql("contacts", "SELECT contact_id, phone FROM contacts"))
def d1(spark, d):
    return _phones(spark, d).select("contact_id", "phone")


@query("d2_phone_last10", sql("contacts", "SELECT contact_id, CASE WHEN length(replace(phone, '+', '')) >= 10 THEN right(replace(phone, '+', ''), 10) END AS last10, phone LIKE '+%' AS coded FROM contacts"))
def d2(spark, d):
    return _phones(spark, d).select("contact_id", keys.phone_last10(F.col("phone")).alias("last10"), keys.has_country_code(F.col("phone")).alias("coded"))


@query("d3_phones_match", sql("contacts", "SELECT a.contact_id, a.phone = b.phone OR (length(replace(a.phone, '+', '')) >= 10 AND right(replace(a.phone, '+', ''), 10) = right(replace(b.phone, '+', ''), 10) AND NOT (a.phone LIKE '+%' AND b.phone LIKE '+%')) AS matches FROM contacts a JOIN contacts b ON b.k = a.k + 1"))
def d3(spark, d):
    own = _phones(spark, d)
    other = own.select((F.col("k") - 1).alias("k"), F.col("phone").alias("other"))
    return own.join(other, "k").select("contact_id", keys.phones_match(F.col("phone"), F.col("other")).alias("matches"))


@query("d4_email_normal_form", sql("contacts", "SELECT contact_id, email, email AS stripped FROM contacts"))
def d4(spark, d):
    own = v.contacts_raw(spark, d).select("contact_id", F.get("emails", 0).alias("raw"))
    tagged = F.concat(F.lit("  "), F.replace("raw", F.lit("@"), F.lit("+tag@")), F.lit(" "))
    return own.select("contact_id", keys.normalize_email(F.col("raw")).alias("email"), keys.normalize_email(tagged, True).alias("stripped"))


@query("d5_field_count", sql("contacts", "SELECT contact_id, field_count FROM contacts"))
def d5(spark, d):
    c = v.contacts_raw(spark, d)
    return c.select("contact_id", keys.field_count(*[F.col(x) for x in ("given", "family", "phones", "emails", "has_image")]).alias("field_count"))


@query("d6_display_name", sql("contacts", "SELECT contact_id, name FROM contacts"))
def d6(spark, d):
    return v.contacts_raw(spark, d).select("contact_id", keys.display_name(F.col("given"), F.col("family")).alias("name"))


def _names(spark, d):
    own = v.contacts_raw(spark, d).select("contact_id", "k", keys.display_name(F.col("given"), F.col("family")).alias("a"))
    return own.join(own.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")


@query("d7_levenshtein", sql("contacts", "SELECT a.contact_id, levenshtein(a.name, b.name) AS distance FROM contacts a JOIN contacts b ON b.k = a.k + 1"))
def d7(spark, d):
    return _names(spark, d).select("contact_id", F.levenshtein("a", "b").alias("distance"))


@query("d8_name_normal_form", sql("named", "SELECT contact_id, plain FROM named"))
def d8(spark, d):
    return _names_of(spark, d).select("contact_id", keys.name_normal_form(F.col("a")).alias("plain"))


def _names_of(spark, d):
    return v.contacts_raw(spark, d).select("contact_id", keys.display_name(F.col("given"), F.col("family")).alias("a"))


@query("d9_token_sorted", sql("named", "SELECT contact_id, sorted FROM named"))
def d9(spark, d):
    return _names_of(spark, d).select("contact_id", keys.token_sorted(keys.name_normal_form(F.col("a"))).alias("sorted"))


@query("d10_name_score", sql("named", """SELECT a.contact_id, round(CASE WHEN a.plain = '' AND b.plain = '' THEN 1 WHEN a.plain = '' OR b.plain = '' THEN 0 ELSE greatest(1 - levenshtein(a.plain, b.plain) / greatest(length(a.plain), length(b.plain)), 1 - levenshtein(a.sorted, b.sorted) / greatest(length(a.sorted), length(b.sorted))) END, 9) AS score
 FROM named a JOIN named b ON CAST(b.contact_id AS BIGINT) = CAST(a.contact_id AS BIGINT) + 1"""))
def d10(spark, d):
    return _names(spark, d).select("contact_id", F.round(keys.name_score(F.col("a"), F.col("b")), 9).alias("score"))


for _name, _view, _f in (
    ("d11a_phone_edges", "phone_edges", contacts.phone_edges),
    ("d11b_email_edges", "email_edges", contacts.email_edges),
    ("d11d_weak_phones", "weak_phones", contacts.weak_phone_pairs),
    ("d11e_weak_emails", "weak_emails", contacts.weak_email_pairs),
    ("d11f_probable_edges", "probable_edges", contacts.probable_edges),
):
    query(_name, sql(_view, f"SELECT u, v FROM {_view}"))(lambda spark, d, f=_f: f(customers(spark, d)))


_WEAK_CLASSES = """SELECT contact_id, key, f AS full, min(contact_id) OVER (PARTITION BY key, f) AS class_id, count(*) OVER (PARTITION BY key, f) AS n_class,
 count(*) OVER (PARTITION BY key) - count(*) OVER (PARTITION BY key, f) AS n_links FROM entries WHERE kind = '{kind}' AND key IS NOT NULL QUALIFY n_links > 0"""
_ENTRIES = """SELECT contact_id, 'phone' AS kind, phone AS f, CASE WHEN length(replace(phone, '+', '')) >= 10 THEN right(replace(phone, '+', ''), 10) END AS key FROM contacts
 UNION ALL SELECT contact_id, 'email', email, split_part(email, '@', 1) FROM contacts WHERE email IS NOT NULL"""


@query("d11d_weak_phone_classes", sql("contacts", _WEAK_CLASSES.format(kind="phone"), entries=_ENTRIES))
def d11d_classes(spark, d):
    return contacts.weak_classes(contacts.entries(customers(spark, d)), "phone")


@query("d11e_weak_email_classes", sql("contacts", _WEAK_CLASSES.format(kind="email"), entries=_ENTRIES))
def d11e_classes(spark, d):
    return contacts.weak_classes(contacts.entries(customers(spark, d)), "email")


@query("d11f_probable_classes", sql("contacts named", "SELECT kind, key, letter, contact_id, min(other) AS class_id FROM closed GROUP BY 1, 2, 3, 4", entries=_ENTRIES,
    blocks="SELECT DISTINCT kind, key, letter, contact_id, plain, sorted FROM entries JOIN (SELECT kind, key FROM entries WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT f) > 1) USING (kind, key) JOIN named USING (contact_id)",
    close_names="""SELECT a.kind, a.key, a.letter, a.contact_id AS u, b.contact_id AS v FROM blocks a JOIN blocks b USING (kind, key, letter) WHERE a.contact_id <> b.contact_id
 AND greatest(1 - levenshtein(a.plain, b.plain) / greatest(length(a.plain), length(b.plain)), 1 - levenshtein(a.sorted, b.sorted) / greatest(length(a.sorted), length(b.sorted))) >= 0.9""",
    closed="SELECT kind, key, letter, u AS contact_id, u AS other FROM close_names UNION SELECT c.kind, c.key, c.letter, c.contact_id, n.v FROM closed c JOIN close_names n ON n.kind = c.kind AND n.key = c.key AND n.letter = c.letter AND n.u = c.other"))
def d11f_classes(spark, d):
    return contacts.probable_classes(customers(spark, d)).withColumnRenamed("of", "kind")


@query("d11c_block_letter", sql("contacts", "SELECT contact_id, letter FROM contacts"))
def d11c(spark, d):
    return v.contacts_raw(spark, d).select("contact_id", keys.block_letter(F.col("given"), F.col("family")).alias("letter"))


@query("d12_contact_groups", sql("contact_members", "SELECT group_id, contact_id FROM contact_members"))
def d12(spark, d):
    return contacts.link_contacts(stage(customers(spark, d)))[1]


@query("d13_tiers", sql("contact_groups", "SELECT group_id, tier, confidence, match_reason, n_members FROM contact_groups"))
def d13(spark, d):
    return contacts.link_contacts(stage(customers(spark, d)))[0].drop("recommended_primary")


@query("d14_primary", sql("contact_groups", "SELECT group_id, recommended_primary FROM contact_groups"))
def d14(spark, d):
    return contacts.link_contacts(stage(customers(spark, d)))[0].select("group_id", "recommended_primary")


@query("d15_field_diffs", sql("contact_groups contacts_raw", """SELECT group_id, contact_id, 'Name' AS label, pn AS primary_value, n AS other_value, false AS is_loss FROM b
 UNION ALL SELECT group_id, contact_id, 'Phone', CASE WHEN x = pp THEN x END, CASE WHEN x = phone THEN x END, x <> pp FROM (SELECT *, unnest(list_distinct([pp, phone])) AS x FROM b)
 UNION ALL SELECT group_id, contact_id, 'Email', CASE WHEN x = pe THEN x END, CASE WHEN x = email THEN x END, x IS DISTINCT FROM pe FROM (SELECT *, unnest(list_distinct([pe, email])) AS x FROM b) WHERE x IS NOT NULL""",
    b="""SELECT m.group_id, m.contact_id, nullif(trim(o.given || ' ' || o.family), '') AS n, nullif(trim(p.given || ' ' || p.family), '') AS pn, o.phone, p.phone AS pp, o.email, p.email AS pe
 FROM contact_members m JOIN contact_groups g USING (group_id) JOIN contacts_raw o ON o.contact_id = m.contact_id JOIN contacts_raw p ON p.contact_id = g.recommended_primary WHERE m.contact_id <> g.recommended_primary"""))
def d15(spark, d):
    groups, members = contacts.link_contacts(stage(customers(spark, d)))
    return contacts.field_diffs(groups, members, v.contacts_raw(spark, d))


# --- orders and previews ---


@query("o1_largest_first", sql("videos", "SELECT asset_id, row_number() OVER (ORDER BY byte_size DESC, asset_id) AS rank FROM videos"))
def o1(spark, d):
    return review.largest_first(v.videos(spark, d).select("asset_id", "byte_size")).select("asset_id", "rank")


@query("o2_newest_videos", sql("videos", "SELECT asset_id, row_number() OVER (ORDER BY creation_s DESC NULLS LAST, asset_id) AS rank FROM videos"))
def o2(spark, d):
    return review.newest_first(v.videos(spark, d).select("asset_id", "creation_ts")).select("asset_id", "rank")


@query("o3_newest_screenshots", sql("assets", "SELECT asset_id, row_number() OVER (ORDER BY creation_s DESC NULLS LAST, asset_id) AS rank FROM assets WHERE is_screenshot"))
def o3(spark, d):
    return review.newest_first(scans.screenshots(v.assets(spark, d)).select("asset_id", "creation_ts")).select("asset_id", "rank")


@query("o4_scan_time_order", sql("videos", "SELECT asset_id, byte_size, row_number() OVER (ORDER BY byte_size DESC, asset_id) AS rank FROM videos"))
def o4(spark, d):
    return review.largest_first(scans.sizes_or_zero(v.videos(spark, d).select("asset_id"), v.videos(spark, d))).select("asset_id", "byte_size", "rank")


@query("o5_group_preview", sql("members", "SELECT group_id, asset_id, row_number() OVER (PARTITION BY group_id ORDER BY member_pos, asset_id) AS rank FROM members QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY member_pos, asset_id) <= 3"))
def o5(spark, d):
    return review.preview(v.reviewed(spark, d)[1]).select("group_id", "asset_id", "rank")


@query("o6_groups_in_order", sql("contact_groups", "SELECT group_id, row_number() OVER (ORDER BY group_id) AS rank FROM contact_groups"))
def o6(spark, d):
    return review.ranked(contacts.link_contacts(stage(customers(spark, d)))[0].select("group_id"), "group_id")


# --- sums and summaries ---


@query("g1_recoverable_by_group", sql("members", "SELECT group_id, CAST(sum(CASE WHEN selected THEN byte_size ELSE 0 END) AS BIGINT) AS recoverable_bytes FROM members GROUP BY 1"))
def g1(spark, d):
    return review.recoverable_by_group(v.reviewed(spark, d)[1])


@query("g2_recoverable_total", sql("selection", "SELECT CAST(sum(byte_size) AS BIGINT) AS total_bytes, (SELECT CAST(sum(b) AS BIGINT) FROM (SELECT max(byte_size) AS b FROM selection GROUP BY item_id)) AS distinct_bytes FROM selection"))
def g2(spark, d):
    return review.recoverable_total(v.selection(spark, d))


_BY_CATEGORY = "SELECT c.category, CAST(coalesce(sum(s.byte_size), 0) AS BIGINT) AS recoverable_bytes FROM (VALUES ('photo'), ('screenshot'), ('video'), ('contact')) c(category) LEFT JOIN selection s ON s.category = c.category AND s.category <> 'contact' GROUP BY 1"


@query("g3_recoverable_by_category", sql("selection", _BY_CATEGORY))
def g3(spark, d):
    return review.recoverable_by_category(v.selection(spark, d))


@query("g3_recoverable_map", sql("selection", f"SELECT string_agg(category || '=' || recoverable_bytes, ',' ORDER BY category) AS entries FROM ({_BY_CATEGORY})"))
def g3_map(spark, d):
    found = review.as_map(review.recoverable_by_category(v.selection(spark, d)))
    return found.select(F.array_join(F.transform(F.array_sort(F.map_entries("recoverable")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("entries"))


@query("g4_selected_bytes", sql("members", "SELECT CAST(coalesce(sum(byte_size) FILTER (WHERE selected), 0) AS BIGINT) AS selected_bytes FROM members"))
def g4(spark, d):
    return review.selected_bytes(v.reviewed(spark, d)[1])


@query("g5_selection_counts", sql("selection", "SELECT count(*) AS total_items, count(*) = 0 AS is_empty FROM (SELECT DISTINCT category, item_id FROM selection)"))
def g5(spark, d):
    return review.selection_counts(v.selection(spark, d))


@query("g6_dashboard", sql("everything selection", "SELECT category, count(DISTINCT n % 7) AS n_groups, count(DISTINCT e.item_id) AS n_found, count(DISTINCT s.item_id) AS n_selected FROM everything e LEFT JOIN selection s USING (category, item_id) GROUP BY 1"))
def g6(spark, d):
    return review.dashboard(v.everything(spark, d).withColumn("group_id", F.col("n") % 7), v.selection(spark, d))


@query("g7_storage_summary", sql("capacity selection", "SELECT CAST(total AS BIGINT) AS total, CAST(available AS BIGINT) AS available, CAST(greatest(0, total - available) AS BIGINT) AS used, total_bytes, distinct_bytes FROM capacity, (SELECT CAST(sum(byte_size) AS BIGINT) AS total_bytes FROM selection), (SELECT CAST(sum(b) AS BIGINT) AS distinct_bytes FROM (SELECT max(byte_size) AS b FROM selection GROUP BY item_id)) WHERE phase = 'before'"))
def g7(spark, d):
    return cleanup.storage_summary(v.capacity(spark, d), review.recoverable_total(v.selection(spark, d)))


@query("g8_bytes_freed", sql("capacity", "SELECT CAST(greatest(0, max(available) FILTER (WHERE phase = 'after') - max(available) FILTER (WHERE phase = 'before')) AS BIGINT) AS bytes_freed FROM capacity"))
def g8(spark, d):
    return cleanup.bytes_freed(v.capacity(spark, d))


_SUMMARY = """SELECT category, count(*) AS n_requested, count(*) FILTER (WHERE confirmed) AS n_confirmed, count(*) - count(*) FILTER (WHERE confirmed) AS n_failed, count(*) > count(*) FILTER (WHERE confirmed) AND count(*) FILTER (WHERE confirmed) > 0 AS is_partial FROM plan LEFT JOIN executed USING (item_id) GROUP BY 1"""


def _planned(spark, d):
    return cleanup.plan(v.selection(spark, d), v.live(spark, d), v.grants(spark, d))


@query("g9_cleanup_summary", sql("plan executed", _SUMMARY))
def g9(spark, d):
    planned = stage(_planned(spark, d))
    return cleanup.summary(planned, cleanup.execute(planned, v.outcomes(spark, d)))


# --- set operations, selection, reconciliation ---


@query("r1_media_ids", sql("selection", "SELECT DISTINCT item_id FROM selection WHERE category <> 'contact'"))
def r1(spark, d):
    return review.media_ids(v.selection(spark, d))


@query("r2_current_selection", sql("selection members", "SELECT DISTINCT category, item_id FROM selection UNION SELECT 'photo', 'p' || asset_id FROM members WHERE selected"))
def r2(spark, d):
    members = v.reviewed(spark, d)[1].where("selected").select(F.lit("photo").alias("category"), F.concat(F.lit("p"), "asset_id").alias("item_id"))
    return review.current_selection(v.selection(spark, d), members)


@query("r4_select_all_but_keep", sql("members", "SELECT group_id, asset_id, asset_id <> coalesce(user_keep, recommended_keep) AS selected, false AS cleared FROM members JOIN groups USING (group_id)"))
def r4(spark, d):
    groups, members = v.reviewed(spark, d)
    chosen = review.select_all_but_keep(members, groups).select("group_id", "asset_id", "selected")
    return chosen.join(review.deselect_all(members).select("group_id", "asset_id", F.col("selected").alias("cleared")), ["group_id", "asset_id"])


_CHOICE = "SELECT group_id, min(asset_id) AS choice FROM members WHERE member_pos % 9 = 0 GROUP BY 1"


@query("r4_deselect_all", sql("members", "SELECT group_id, asset_id, false AS selected FROM members"))
def r4_deselect(spark, d):
    return review.deselect_all(v.reviewed(spark, d)[1]).select("group_id", "asset_id", "selected")


@query("r5_override_keep", sql("members", "SELECT group_id, asset_id, selected AND asset_id <> coalesce(choice, user_keep, recommended_keep) AS selected, coalesce(choice, user_keep, recommended_keep) AS keep FROM members JOIN groups USING (group_id) LEFT JOIN choices USING (group_id)", choices=_CHOICE))
def r5(spark, d):
    groups, members = v.reviewed(spark, d)
    choices = members.where("member_pos % 9 = 0").select("group_id", "asset_id").union(members.select("group_id", F.lit("no member")))
    groups, members = review.override_keeps(groups, members, choices)
    return members.join(groups.select("group_id", review.effective_keep().alias("keep")), "group_id").select("group_id", "asset_id", "selected", "keep")


_REPLAY = sql("log", """SELECT m.group_id, m.asset_id, coalesce(selected, false) AS selected FROM m LEFT JOIN (
 SELECT group_id, asset_id, (arg_max(base, seq) != (arg_max(flips, seq) % 2 = 1)) AS selected FROM s GROUP BY 1, 2) USING (group_id, asset_id)""",
    m="SELECT DISTINCT CAST(user_id AS VARCHAR) AS group_id, CAST(i AS VARCHAR) AS asset_id FROM events, (SELECT unnest(range(5)) AS i)",
    k="SELECT m.group_id, m.asset_id, seq, op, item, coalesce(last_value(CASE WHEN op = 'set_keep' THEN item END IGNORE NULLS) OVER (PARTITION BY m.group_id, m.asset_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '0') AS keep FROM m JOIN log ON log.group_id = m.group_id",
    r="SELECT *, CASE WHEN op = 'select_all' THEN asset_id <> keep WHEN op = 'deselect_all' THEN false WHEN op = 'set_keep' AND item = asset_id THEN false END AS reset, CAST(op = 'toggle' AND item = asset_id AND keep <> asset_id AS INT) AS flip FROM k",
    p="SELECT *, count(reset) OVER (PARTITION BY group_id, asset_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS phase FROM r",
    s="SELECT *, coalesce(bool_or(reset) OVER (PARTITION BY group_id, asset_id, phase), false) AS base, sum(flip) OVER (PARTITION BY group_id, asset_id, phase) AS flips FROM p")


@query("r8_selection_replay", _REPLAY)
def r8(spark, d):
    log = v.selection_log(spark, d)
    groups = log.select("group_id", F.lit("0").alias("recommended_keep")).distinct()
    members = groups.select("group_id", F.explode(F.array(*[F.lit(str(i)) for i in range(5)])).alias("asset_id"))
    return review.replay(log, members, groups)


@query("r8_streamed_selection", _REPLAY)
def r8_stream(spark, d):
    """The same selection from the log as a stream, with each group's state in the state store."""
    log = v.selection_log(spark, d)
    groups = stage(log.select("group_id", F.lit("0").alias("recommended_keep")).distinct(), "groups")
    members = groups.select("group_id", F.explode(F.array(*[F.lit(str(i)) for i in range(5)])).alias("asset_id"))
    streams.use_rocksdb(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*").parquet(d)
    out = f"{shared_folder(spark)}/selection-{spark.range(1).select(F.uuid()).first()[0]}"
    found = streams.selection_changes(v.logged(stream), members, groups)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return streams.standing_selection(spark.read.schema(found.schema).parquet(out), members)


@query("r9_revalidate", sql("selection live", "SELECT category, s.item_id, l.item_id IS NOT NULL AS is_valid FROM selection s LEFT JOIN live l USING (item_id)"))
def r9(spark, d):
    return cleanup.revalidate(v.selection(spark, d), v.live(spark, d)).select("category", "item_id", "is_valid")


@query("r10_permission_gate", sql("selection grants", "SELECT category, item_id, usable AS is_permitted FROM selection JOIN grants ON domain = CASE WHEN category = 'contact' THEN 'contacts' ELSE 'media' END"))
def r10(spark, d):
    return cleanup.permitted(v.selection(spark, d), v.grants(spark, d)).select("category", "item_id", "is_permitted")


@query("r11_valid_by_category", sql("selection live", "SELECT DISTINCT category, item_id FROM selection WHERE item_id IN (SELECT item_id FROM live)"))
def r11(spark, d):
    return cleanup.still_valid(v.selection(spark, d), v.live(spark, d))


@query("r12_execute", sql("executed", "SELECT domain, item_id, confirmed, CASE WHEN NOT confirmed THEN 'frameworkError' END AS reason, CASE WHEN NOT confirmed THEN 'Not confirmed by system' END AS detail FROM executed"))
def r12(spark, d):
    return cleanup.execute(_planned(spark, d), v.outcomes(spark, d))


@query("r12_domain_error", sql("plan", "SELECT DISTINCT domain, item_id, false AS confirmed, 'store offline' AS detail FROM plan WHERE verdict = 'execute'"))
def r12_error(spark, d):
    errors = spark.createDataFrame([("media", "store offline")], "domain string, error string")
    return cleanup.execute(_planned(spark, d), v.outcomes(spark, d), errors).select("domain", "item_id", "confirmed", "detail")


_FIRST = "SELECT item_id, arg_min(category, CASE category WHEN 'photo' THEN 0 WHEN 'screenshot' THEN 1 WHEN 'video' THEN 2 ELSE 3 END) AS category FROM selection GROUP BY 1"


@query("r13_failure_category", sql("selection", _FIRST))
def r13(spark, d):
    return cleanup.failure_category(v.selection(spark, d)).select("item_id", "category")


def _cleaned(spark, d):
    rows = stage(v.everything(spark, d), "everything")
    return cleanup.run_cleanup(v.selection(spark, d, rows), v.live(spark, d, rows), v.grants(spark, d), v.outcomes(spark, d, rows), v.capacity(spark, d, rows), confirmed=True)


@query("r14_cleanup_failures", sql("plan executed", "SELECT DISTINCT category, item_id, reason FROM (SELECT item_id, verdict AS reason FROM plan WHERE verdict <> 'execute' UNION SELECT item_id, 'frameworkError' FROM executed WHERE NOT confirmed) JOIN firsts USING (item_id)", firsts=_FIRST))
def r14(spark, d):
    done = _cleaned(spark, d)
    return done["failures"].select("category", "item_id", "reason")


@query("r14_cleanup_summary", sql("plan executed capacity", f"SELECT s.*, (SELECT CAST(max(available) FILTER (WHERE phase = 'after') - max(available) FILTER (WHERE phase = 'before') AS BIGINT) FROM capacity) AS bytes_freed FROM ({_SUMMARY}) s"))
def r14_summary(spark, d):
    done = _cleaned(spark, d)
    return done["summary"].withColumn("one", F.lit(1)).join(done["bytes_freed"].withColumn("one", F.lit(1)), "one").drop("one")


_ALIVE = "SELECT * FROM members WHERE member_pos % 3 <> 2"
_PRUNED = """SELECT group_id, CASE WHEN recommended_keep IN (SELECT asset_id FROM alive) THEN recommended_keep ELSE f END AS recommended_keep, CASE WHEN user_keep IN (SELECT asset_id FROM alive) THEN user_keep END AS user_keep FROM groups JOIN (SELECT group_id, arg_min(asset_id, member_pos) AS f FROM alive GROUP BY 1 HAVING count(*) > 1) USING (group_id)"""


@query("r15_prune_assets", sql("members", "SELECT group_id, asset_id, selected AND asset_id <> coalesce(user_keep, recommended_keep) AS selected, recommended_keep, user_keep FROM alive JOIN pruned USING (group_id)", alive=_ALIVE, pruned=_PRUNED))
def r15(spark, d):
    groups, members = v.reviewed(spark, d)
    groups, members = cleanup.prune(groups, members, members.where("member_pos % 3 = 2").select(F.col("asset_id").alias("item_id")))
    return members.join(groups, "group_id").select("group_id", "asset_id", "selected", "recommended_keep", "user_keep")


@query("r16_prune_contacts", sql("contact_groups", """SELECT group_id, contact_id, CASE WHEN recommended_primary IN (SELECT contact_id FROM alive) THEN recommended_primary ELSE f END AS recommended_primary FROM alive JOIN contact_groups USING (group_id)
 JOIN (SELECT group_id, min(contact_id) AS f FROM alive GROUP BY 1 HAVING count(*) > 1) USING (group_id)""", alive="SELECT * FROM contact_members WHERE CAST(contact_id AS BIGINT) % 7 <> 0"))
def r16(spark, d):
    groups, members = contacts.link_contacts(stage(customers(spark, d)))
    members = members.withColumn("member_pos", F.col("contact_id")).withColumn("selected", F.lit(False))
    gone = members.where(F.col("contact_id").cast("long") % 7 == 0).select(F.col("contact_id").alias("item_id"))
    groups, members = cleanup.prune(stage(groups), stage(members), gone, "contact_id", "recommended_primary")
    return members.join(groups, "group_id").select("group_id", "contact_id", "recommended_primary")


@query("r17_kept_but_selected", sql("members", "SELECT group_id, asset_id FROM members JOIN groups USING (group_id) WHERE member_pos % 2 = 0 AND asset_id = coalesce(user_keep, recommended_keep)"))
def r17(spark, d):
    groups, members = v.reviewed(spark, d)
    return review.kept_but_selected(members.withColumn("selected", F.col("member_pos") % 2 == 0), groups).select("group_id", "asset_id")


# --- text audits ---

def _hit(name: str, pattern: str) -> str:
    """SQL that tells whether a line matches; the hosts that one rule excludes are a condition of its own there."""
    text = pattern.replace("'", "''")
    if "(?!" not in pattern:
        return f"regexp_matches(line, '{text}')"
    before, _, rest = text.partition("(?!")
    hosts, _, after = rest.partition(")")
    return f"len(list_filter(regexp_extract_all(line, '{before}{after}'), lambda u: NOT regexp_matches(u, '{before.replace(chr(92) + 'b', '^')}({hosts})'))) > 0"


#: A line for each kind of document that rules must find, or must leave alone.
PLANTED = [
    "concat('key AKIA', upper(substr(md5(cast(doc_id as string)), 1, 16)))", "concat('see https://localhost/', doc_id, ' and http://127.0.0.1/x')", "concat('see https://apple.com/', doc_id, ' and https://site', doc_id, '.example/x')",
    "concat('password = \"', md5(cast(doc_id as string)), '\"')", "concat('Bearer ', md5(cast(doc_id as string)))", "concat('ghp_', substr(concat(md5(cast(doc_id as string)), md5(lang)), 1, 36))", "'let s = URLSession.shared; s.dataTask(with: u)'", "'import Firebase // stored in iCloud.com'",
    "'-----BEGIN RSA PRIVATE KEY-----'", "concat('xoxb-', doc_id, '-short')", "'nothing: ghp_short, AKIA123, bearer no'",
]
_CASES = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(PLANTED))
_PLANTED_SQL = f"SELECT 'x' || CAST(doc_id AS VARCHAR) AS item, 1 AS lineno, CASE doc_id % {len(PLANTED)} {_CASES} END AS line FROM documents".replace("as string", "as varchar")
_HITS = " UNION ALL ".join(f"SELECT '{n}' AS rule, item, lineno FROM lines WHERE {_hit(n, p)}" for n, p in audit.RULES.items())
_AUDITED = f"WITH lines AS ({_LINES} UNION ALL SELECT item, line, lineno FROM ({_PLANTED_SQL}))"
_FINDINGS = f"{_AUDITED}, findings AS ({_HITS}) "


def audited(spark: SparkSession, d: str) -> DataFrame:
    """The lines of documents and pages, and a planted line for each document."""
    planted = table(spark, d, "documents").select(F.expr("concat('x', doc_id)").alias("item"), F.lit(1).alias("lineno"), F.expr(f"case doc_id % {len(PLANTED)} {_CASES} end").alias("line"))
    return lines(spark, d).select("item", "lineno", "line").union(planted)


@query("f5_pattern_scan", f"{_FINDINGS} SELECT rule, item, lineno FROM findings")
def f5(spark, d):
    return audit.scan_lines(audited(spark, d))


def _allowed(spark, d):
    return table(spark, d, "documents").where("doc_id % 3 = 0").select(F.lit("NETWORK_HTTP_URL").alias("rule"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("item"))


@query("f5_marker_lines", f"WITH lines AS ({_LINES}) SELECT 'MARKER' AS rule, item, lineno FROM lines WHERE regexp_matches(line, 'token = |<footer>')")
def f5_marker(spark, d):
    return audit.scan_lines(lines(spark, d), {"MARKER": "token = |<footer>"})


@query("f6_allow_list", f"{_FINDINGS} SELECT rule, item, lineno FROM findings WHERE NOT (rule = 'NETWORK_HTTP_URL' AND item LIKE 'x%' AND CAST(item[2:] AS BIGINT) % 3 = 0) AND item <> 'x14'")
def f6(spark, d):
    return audit.without_allowed(audit.scan_lines(audited(spark, d), skip=["x14"]), _allowed(spark, d))


@query("f7_verdict", f"{_FINDINGS} SELECT r.rule, count(f.rule) AS n_findings, count(f.rule) = 0 AS passed FROM (VALUES {', '.join(f"('{n}')" for n in audit.RULES)}) r(rule) LEFT JOIN findings f USING (rule) GROUP BY 1")
def f7(spark, d):
    return audit.verdict(audit.scan_lines(audited(spark, d)))


_FIRST_WORD = r"^\s*([A-Za-z_][A-Za-z0-9_]*)"


@query("f8_tokens_off_list", rf"WITH lines AS ({_LINES}) SELECT item, lineno, regexp_extract(line, '{_FIRST_WORD}', 1) AS token FROM lines WHERE regexp_extract(line, '{_FIRST_WORD}', 1) NOT IN ('', 'The', 'Of', 'And')")
def f8(spark, d):
    return audit.tokens_off_list(lines(spark, d), _FIRST_WORD, ["The", "Of", "And"])


@query("f8_denied_tokens", rf"WITH lines AS ({_LINES}) SELECT item, lineno, regexp_extract(line, '{_FIRST_WORD}', 1) AS token FROM lines WHERE regexp_extract(line, '{_FIRST_WORD}', 1) IN ('The', 'Of', 'And')")
def f8_deny(spark, d):
    return audit.tokens_off_list(lines(spark, d), _FIRST_WORD, ["The", "Of", "And"], deny=True)


# --- incremental and streaming ---


@query("t1_changed_since", sql("assets", "SELECT asset_id FROM assets WHERE doc_id % 4 = 0 OR doc_id % 6 = 0"))
def t1(spark, d):
    rows = v.assets(spark, d)
    snapshot = rows.where("doc_id % 4 <> 0").select("asset_id", F.when(F.col("doc_id") % 6 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("modification_ts")).alias("modification_ts"), F.lit(scans.SCHEMA_VERSION).alias("schema_version"))
    return scans.changed_since(rows, snapshot).select("asset_id")


@query("t1_streamed_rescan", sql("assets", "SELECT asset_id FROM assets WHERE doc_id % 4 = 0 OR doc_id % 6 = 0"))
def t1_stream(spark, d):
    """The same rescan over a stream of assets: what each micro-batch has to scan is written out."""
    known = v.assets(spark, d).where("doc_id % 4 <> 0").select("asset_id", F.when(F.col("doc_id") % 6 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("modification_ts")).alias("modification_ts"))
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    assets = stream.select(v.padded("doc_id").alias("asset_id"), F.timestamp_seconds(F.lit(v._EPOCH) + F.col("doc_id")).alias("modification_ts"))
    path = f"{shared_folder(spark)}/rescan-{spark.range(1).select(F.uuid()).first()[0]}"
    streams.rescan_batch(known, -1, path, lambda rows: rows.select("asset_id").where("false"))
    streams.rescans(assets, path, lambda rows: rows.select("asset_id"), f"{path}-state").awaitTermination()
    return streams.scan_results(spark, path)


@query("t2_streamed_bursts", f"""SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS session_size FROM ({_GAPS.format(p='PARTITION BY user_id', g=3600)}) GROUP BY user_id, s HAVING count(*) > 1 AND max(ts) + INTERVAL 3600 SECOND < (SELECT max(ts) - INTERVAL 600 SECOND FROM events)""")
def t2(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts")
    out = f"{shared_folder(spark)}/bursts-{spark.range(1).select(F.uuid()).first()[0]}"
    found = streams.bursts(stream, ["user_id"], "ts", "3600 seconds")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("user_id", F.unix_micros("session_start").alias("start_us"), "session_size")


@query("t2_growing_bursts", f"""SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) AS end_us, count(*) AS session_size FROM ({_GAPS.format(p='PARTITION BY user_id', g=3600)}) GROUP BY user_id, s HAVING count(*) > 1""")
def t2_growing(spark, d):
    """How all bursts stand after the stream: closed ones and those still open."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts")
    streams.use_rocksdb(spark)
    out = f"{shared_folder(spark)}/growing-{spark.range(1).select(F.uuid()).first()[0]}"
    found = streams.growing_bursts(stream, ["user_id"], "ts", 3600)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    standing = streams.latest_bursts(spark.read.schema(found.schema).parquet(out), ["user_id"])
    return standing.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "session_size")
