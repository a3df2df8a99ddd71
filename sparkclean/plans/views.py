"""Views that give the shared tables the shape of the operators' inputs, in Spark and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import dhash
from ..storage import table

GIVEN = ["John", "Jon", "Maria", "Marie", "Alex", "Wei", "Anna"]
FAMILY = ["Smith", "Smyth", "Garcia", "Morgan", "Chen"]
_EPOCH = 1704067200
#: Words whose cells a task remembers at once.
KNOWN_WORDS = 1 << 19


def padded(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 12, "0")


def assets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    at = F.timestamp_seconds(F.lit(_EPOCH) + 30 * F.col("n_chars") + (7 * F.col("doc_id")) % 5)
    return docs.select(
        F.col("lang").alias("library_id"), padded("doc_id").alias("asset_id"), F.when(F.col("doc_id") % 13 != 0, at).alias("creation_ts"), (F.length("lang") * 100).alias("width"),
        F.lit(100).alias("height"), F.octet_length("text").cast("long").alias("byte_size"), (F.col("doc_id") % 7 == 3).alias("is_screenshot"), F.lit("photo").alias("media_type"),
        F.timestamp_seconds(F.lit(_EPOCH) + F.col("doc_id")).alias("modification_ts"), F.col("text").alias("content"), "doc_id",
    )


def videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        padded("o_orderkey").alias("asset_id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate").cast("timestamp")).alias("creation_ts"),
        F.floor("o_totalprice").cast("long").alias("byte_size"), (F.col("o_orderkey") % 5000 + 0.5).alias("duration_s"), F.lit("video").alias("media_type"), F.col("o_orderkey").alias("k"),
    )


def contacts_raw(spark: SparkSession, d: str) -> DataFrame:
    """Contacts with planted duplicates: shared phones, country codes, name variants and addresses."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("m", F.expr("k % 10"))
    rows = rows.withColumn("b", F.expr("case when m in (1, 3, 5, 7) then k - 1 when m = 8 then k - 2 else k end"))
    names = lambda values: "array(" + ",".join(f"'{v}'" for v in values) + ")"
    rows = rows.withColumn("g", F.expr(f"{names(GIVEN)}[cast(b % 7 as int)]")).withColumn("f", F.expr(f"{names(FAMILY)}[cast((b div 7) % 5 as int)]"))
    number = "concat('555-', lpad(cast(case when m in (1, 3) then b else k end as string), 7, '0'))"
    return rows.select(
        padded("k").alias("contact_id"), F.expr("case when m = 8 then concat(if(b % 97 = 0, '', f), ',') when b % 97 = 0 then '' else g end").alias("given"),
        F.expr("case when b % 97 = 0 then '' when m = 8 then g else f end").alias("family"),
        F.array(F.expr(f"case when k % 100 = 9 then '(555) 000-0000' when m = 2 then concat('+1 ', {number}) when m = 3 then concat('+44 ', {number}) else {number} end")).alias("phones"),
        F.expr("case when m in (4, 6) then array(concat('User', b, '@a.example')) when m in (5, 8) then array(concat('user', b, '@b.example')) when m = 7 then array(concat(' USER', b, '@A.example')) else cast(array() as array<string>) end").alias("emails"),
        F.expr("k % 2 = 0").alias("has_image"), "k",
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")


class _Cells(dict):
    """The cell of each word, by the first two bytes of its digest."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        cell = self[word] = int.from_bytes(md5(word.encode()).digest()[:2], "big") % 72
        return cell


def _word_grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, grid)`` of lower-cased texts with words: an 8 x 9 grid of how many words fall into each cell."""
    cells = _Cells()
    for batch in batches:
        ids, grids = [], []
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            words = (text.as_py() or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
            found = bytes(map(cells.__getitem__, filter(None, words)))
            if found:
                ids.append(doc_id.as_py())
                grids.append(np.bincount(np.frombuffer(found, np.uint8), minlength=72).reshape(8, 9).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(grids, pa.list_(pa.list_(pa.int32())))], ["doc_id", "grid"])


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """``(asset_id, phash)``: the difference hash of an 8 x 9 grid of word counts; a text without words has none."""
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    grids = rows.mapInArrow(_word_grids, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, grid array<array<int>>")
    return grids.select(padded("doc_id").alias("asset_id"), dhash(F.col("grid")).alias("phash"))


def signals(spark: SparkSession, d: str, members: DataFrame | None = None) -> DataFrame:
    """``(asset_id, resolution, sharpness, exposure, byte_size, group_id)``, of ``members`` (``asset_id``) or of all."""
    docs = table(spark, d, "documents").withColumn("asset_id", padded("doc_id"))
    if members is not None:
        docs = docs.join(members, "asset_id", "left_semi")
    exposure = F.round(1 - F.length(F.regexp_replace("text", r"\p{L}+", "")) / F.greatest(F.length("text"), F.lit(1)), 12)
    return docs.select(
        "asset_id", F.col("n_chars").cast("double").alias("resolution"), F.coalesce(F.size(F.array_distinct(_words(F.col("text")))).cast("double"), F.lit(0.0)).alias("sharpness"),
        exposure.alias("exposure"), F.octet_length("text").cast("long").alias("byte_size"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 40).cast("string")).alias("group_id"),
    )


def reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Groups and members under review: forty groups for each language."""
    docs = table(spark, d, "documents").select("doc_id", padded("doc_id").alias("asset_id"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 40).cast("string")).alias("group_id"), F.octet_length("text").cast("long").alias("byte_size"))
    groups = docs.groupBy("group_id").agg(F.min("asset_id").alias("recommended_keep"), F.when(F.min(F.col("doc_id") % 40) % 4 == 1, F.max("asset_id")).alias("user_keep"))
    members = docs.join(groups, "group_id").select("group_id", "asset_id", F.col("doc_id").alias("member_pos"), "byte_size", ((F.col("doc_id") % 3 == 0) & (F.col("asset_id") != F.coalesce("user_keep", "recommended_keep"))).alias("selected"))
    return groups, members


def everything(spark: SparkSession, d: str) -> DataFrame:
    """``(category, item_id, n, byte_size)`` of all photos, screenshots, videos and contacts; screenshots are photos too."""
    photo = assets(spark, d)
    item = lambda p, c: F.concat(F.lit(p), c)
    parts = [
        photo.select(F.lit("photo").alias("category"), item("p", "asset_id").alias("item_id"), F.col("doc_id").alias("n"), "byte_size"),
        photo.where("is_screenshot").select(F.lit("screenshot"), item("p", "asset_id"), "doc_id", "byte_size"),
        videos(spark, d).select(F.lit("video"), item("v", "asset_id"), "k", "byte_size"),
        table(spark, d, "customer").select(F.lit("contact"), item("c", padded("c_custkey")), "c_custkey", F.lit(0).cast("long")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def selection(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return (rows or everything(spark, d)).where("n % 5 = 0").select("category", "item_id", "byte_size")


def live(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return (rows or everything(spark, d)).where("n % 11 <> 0").select("item_id").distinct()


def outcomes(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return (rows or everything(spark, d)).select("item_id", (F.col("n") % 23 != 0).alias("confirmed")).distinct()


def grants(spark: SparkSession, d: str, contacts: bool = False) -> DataFrame:
    return spark.createDataFrame([("media", True), ("contacts", contacts)], "domain string, usable boolean")


def capacity(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Capacity before and after, from the sizes of all items."""
    total = (rows or everything(spark, d)).agg(F.sum("byte_size").alias("b"))
    return total.select(F.lit("before").alias("phase"), (F.col("b") * 2).alias("total"), F.col("b").alias("available")).union(total.select(F.lit("after"), F.col("b") * 2, F.col("b") + 12345))


def selection_log(spark: SparkSession, d: str) -> DataFrame:
    return logged(table(spark, d, "events"))


def logged(e: DataFrame) -> DataFrame:
    """Events as a selection log."""
    op = F.expr("case when event_type in ('click', 'view', 'purchase') then 'toggle' when event_type = 'signup' then 'select_all' when event_id % 2 = 1 then 'deselect_all' else 'set_keep' end")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("group_id"), op.alias("op"), F.when(op.isin("toggle", "set_keep"), (F.col("event_id") % 5).cast("string")).alias("item_id"))


def vector_grids(spark: SparkSession, d: str) -> DataFrame:
    """``(asset_id, grid)``: 8 x 8 brightness values from each embedding of 64 components; others make no such grid."""
    value = lambda v: F.floor((v.cast("double") + 0.5) * 255).cast("int")
    e = table(spark, d, "embeddings").where("size(embedding) = 64")
    return e.select(padded("vec_id").alias("asset_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), value)).alias("grid"))


#: The same views as DuckDB SQL.
SQL = {
    "assets": f"""SELECT lang AS library_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS asset_id, CASE WHEN doc_id % 13 <> 0 THEN {_EPOCH} + 30 * n_chars + (7 * doc_id) % 5 END AS creation_s,
 length(lang) * 100 AS width, 100 AS height, CAST(strlen(text) AS BIGINT) AS byte_size, doc_id % 7 = 3 AS is_screenshot, text AS content, doc_id, {_EPOCH} + doc_id AS modification_s FROM documents""",
    "videos": """SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS asset_id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS creation_s,
 CAST(floor(o_totalprice) AS BIGINT) AS byte_size, o_orderkey % 5000 + 0.5 AS duration_s, o_orderkey AS k FROM orders""",
    "contacts_0": """SELECT c_custkey AS k, c_custkey % 10 AS m, CASE WHEN c_custkey % 10 IN (1, 3, 5, 7) THEN c_custkey - 1 WHEN c_custkey % 10 = 8 THEN c_custkey - 2 ELSE c_custkey END AS b FROM customer""",
    "contacts_1": f"""SELECT *, {GIVEN}[CAST(b % 7 AS INT) + 1] AS g, {FAMILY}[CAST((b // 7) % 5 AS INT) + 1] AS f, '555-' || lpad(CAST(CASE WHEN m IN (1, 3) THEN b ELSE k END AS VARCHAR), 7, '0') AS num FROM contacts_0""",
    "contacts_raw": """SELECT lpad(CAST(k AS VARCHAR), 12, '0') AS contact_id, CASE WHEN m = 8 THEN CASE WHEN b % 97 = 0 THEN '' ELSE f END || ',' WHEN b % 97 = 0 THEN '' ELSE g END AS given, CASE WHEN b % 97 = 0 THEN '' WHEN m = 8 THEN g ELSE f END AS family,
 CASE WHEN k % 100 = 9 THEN '(555) 000-0000' WHEN m = 2 THEN '+1 ' || num WHEN m = 3 THEN '+44 ' || num ELSE num END AS phone,
 CASE WHEN m IN (4, 6) THEN 'User' || b || '@a.example' WHEN m IN (5, 8) THEN 'user' || b || '@b.example' WHEN m = 7 THEN ' USER' || b || '@A.example' END AS email, k % 2 = 0 AS has_image, k FROM contacts_1""",
    "contacts": r"""SELECT contact_id, given, family, CASE WHEN trim(phone) LIKE '+%' THEN '+' ELSE '' END || regexp_replace(phone, '[^\p{N}]', '', 'g') AS phone, lower(trim(email)) AS email,
 CAST(given <> '' AS INT) + CAST(family <> '' AS INT) + 1 + CAST(email IS NOT NULL AS INT) + CAST(has_image AS INT) AS field_count,
 CASE WHEN given = '' AND family = '' THEN '(No Name)' ELSE trim(given || ' ' || family) END AS name, CASE WHEN family <> '' THEN lower(family[1]) WHEN given <> '' THEN lower(given[1]) ELSE '#' END AS letter, k FROM contacts_raw""",
    "tokens": r"""SELECT doc_id, unnest(string_split_regex(lower(text), '[ \t\n\r]+')) AS token FROM documents""",
    "cells": """SELECT doc_id, CAST('0x' || substr(md5(token), 1, 4) AS INT) % 72 AS cell, count(*) AS n FROM tokens WHERE token <> '' GROUP BY 1, 2""",
    "grids": """SELECT doc_id, cell, coalesce(n, 0) AS n FROM (SELECT doc_id, c.cell FROM (SELECT DISTINCT doc_id FROM cells) CROSS JOIN (SELECT unnest(range(72)) AS cell) c) LEFT JOIN cells USING (doc_id, cell)""",
    "hashes": """SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS asset_id, CAST(CASE WHEN h >= (CAST(1 AS HUGEINT) << 63) THEN h - (CAST(1 AS HUGEINT) << 63) - (CAST(1 AS HUGEINT) << 63) ELSE h END AS BIGINT) AS phash FROM (
 SELECT a.doc_id, sum(CASE WHEN a.n < b.n THEN CAST(1 AS HUGEINT) << CAST((a.cell // 9) * 8 + a.cell % 9 AS INT) ELSE 0 END) AS h FROM grids a JOIN grids b ON a.doc_id = b.doc_id AND b.cell = a.cell + 1 AND a.cell % 9 < 8 GROUP BY a.doc_id)""",
    "signals": r"""SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS asset_id, CAST(n_chars AS DOUBLE) AS resolution, CAST(coalesce(s, 0) AS DOUBLE) AS sharpness,
 round(1 - length(regexp_replace(text, '\p{L}', '', 'g')) / greatest(length(text), 1), 12) AS exposure, CAST(strlen(text) AS BIGINT) AS byte_size, lang || '-' || CAST(d.doc_id % 40 AS VARCHAR) AS group_id
 FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT token) AS s FROM tokens WHERE token <> '' GROUP BY 1) t USING (doc_id)""",
    "review_docs": """SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS asset_id, lang || '-' || CAST(doc_id % 40 AS VARCHAR) AS group_id, CAST(strlen(text) AS BIGINT) AS byte_size FROM documents""",
    "groups": """SELECT group_id, min(asset_id) AS recommended_keep, CASE WHEN min(doc_id % 40) % 4 = 1 THEN max(asset_id) END AS user_keep FROM review_docs GROUP BY 1""",
    "members": """SELECT group_id, asset_id, doc_id AS member_pos, byte_size, (doc_id % 3 = 0 AND asset_id <> coalesce(user_keep, recommended_keep)) AS selected FROM review_docs JOIN groups USING (group_id)""",
    "everything": """SELECT 'photo' AS category, 'p' || asset_id AS item_id, doc_id AS n, byte_size FROM assets UNION ALL SELECT 'screenshot', 'p' || asset_id, doc_id, byte_size FROM assets WHERE is_screenshot
 UNION ALL SELECT 'video', 'v' || asset_id, k, byte_size FROM videos UNION ALL SELECT 'contact', 'c' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), c_custkey, 0 FROM customer""",
    "selection": "SELECT category, item_id, byte_size FROM everything WHERE n % 5 = 0",
    "live": "SELECT DISTINCT item_id FROM everything WHERE n % 11 <> 0",
    "outcomes": "SELECT DISTINCT item_id, n % 23 <> 0 AS confirmed FROM everything",
    "grants": "SELECT * FROM (VALUES ('media', true), ('contacts', false)) t(domain, usable)",
    "capacity": "SELECT 'before' AS phase, sum(byte_size) * 2 AS total, sum(byte_size) AS available FROM everything UNION ALL SELECT 'after', sum(byte_size) * 2, sum(byte_size) + 12345 FROM everything",
    "plan": """SELECT category, item_id, d.domain, CASE WHEN NOT usable THEN 'permissionRevoked' WHEN l.item_id IS NULL THEN 'staleIdentifier' ELSE 'execute' END AS verdict FROM (
 SELECT DISTINCT category, item_id, CASE WHEN category = 'contact' THEN 'contacts' ELSE 'media' END AS domain FROM selection) d JOIN grants USING (domain) LEFT JOIN live l USING (item_id)""",
    "executed": """SELECT DISTINCT domain, p.item_id, coalesce(confirmed, false) AS confirmed FROM plan p LEFT JOIN outcomes USING (item_id) WHERE verdict = 'execute'""",
    "log": """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS group_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'toggle' WHEN event_type = 'signup' THEN 'select_all' WHEN event_id % 2 = 1 THEN 'deselect_all' ELSE 'set_keep' END AS op, CAST(event_id % 5 AS VARCHAR) AS item FROM events""",
    "vectors": """SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS asset_id, i // 8 AS y, i % 8 AS x, CAST(floor((CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) + 0.5) * 255) AS INT) AS v FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) = 64""",
    "phone_edges": "SELECT DISTINCT u, contact_id AS v FROM contacts JOIN (SELECT phone, min(contact_id) AS u FROM contacts GROUP BY 1) USING (phone) WHERE u <> contact_id",
    "email_edges": "SELECT DISTINCT u, contact_id AS v FROM contacts JOIN (SELECT email, min(contact_id) AS u FROM contacts WHERE email IS NOT NULL GROUP BY 1) USING (email) WHERE u <> contact_id",
    "exact_edges": "SELECT u, v FROM phone_edges UNION SELECT u, v FROM email_edges",
    "weak_phones": r"""SELECT a.contact_id AS u, b.contact_id AS v FROM contacts a JOIN contacts b ON right(replace(a.phone, '+', ''), 10) = right(replace(b.phone, '+', ''), 10) AND length(replace(a.phone, '+', '')) >= 10 AND length(replace(b.phone, '+', '')) >= 10 AND a.phone <> b.phone AND a.contact_id < b.contact_id""",
    "weak_emails": "SELECT a.contact_id AS u, b.contact_id AS v FROM contacts a JOIN contacts b ON split_part(a.email, '@', 1) = split_part(b.email, '@', 1) AND a.email <> b.email AND a.contact_id < b.contact_id",
    "named": r"""SELECT contact_id, letter, trim(regexp_replace(lower(replace(name, ',', ' ')), '\s+', ' ', 'g')) AS plain, array_to_string(list_sort(string_split(trim(regexp_replace(lower(replace(name, ',', ' ')), '\s+', ' ', 'g')), ' ')), ' ') AS sorted FROM contacts""",
    "probable_edges": """SELECT DISTINCT u, v FROM (SELECT u, v FROM weak_phones UNION SELECT u, v FROM weak_emails) w JOIN named a ON u = a.contact_id JOIN named b ON v = b.contact_id
 WHERE a.letter = b.letter AND greatest(1 - levenshtein(a.plain, b.plain) / greatest(length(a.plain), length(b.plain)), 1 - levenshtein(a.sorted, b.sorted) / greatest(length(a.sorted), length(b.sorted))) >= 0.9 AND (u, v) NOT IN (SELECT (u, v) FROM exact_edges)""",
    "contact_links": "SELECT u, v, true AS exact FROM exact_edges UNION ALL SELECT u, v, false FROM probable_edges",
    "contact_reach": "SELECT u AS node, u AS other FROM contact_links UNION SELECT v, v FROM contact_links UNION SELECT r.node, CASE WHEN l.u = r.other THEN l.v ELSE l.u END FROM contact_reach r JOIN contact_links l ON l.u = r.other OR l.v = r.other",
    "contact_members": "SELECT node AS contact_id, min(other) AS group_id FROM contact_reach GROUP BY 1",
    "contact_groups": """SELECT group_id, CASE WHEN n <= 8 AND exact THEN 'exact' ELSE 'probable' END AS tier, CAST(CASE WHEN n > 8 THEN 0.375 WHEN exact THEN 1.0 ELSE 0.75 END AS DOUBLE) AS confidence,
 CASE WHEN n > 8 THEN 'Large group of ' || n || ' — shared contact info may indicate a shared line, not duplicate people. Review carefully.' WHEN exact THEN 'Same phone number or email address' ELSE 'Similar name with a related phone number or email' END AS match_reason,
 primary_id AS recommended_primary, n AS n_members FROM (SELECT group_id, count(*) AS n, arg_min(contact_id, -field_count * 1e12 + CAST(contact_id AS BIGINT)) AS primary_id FROM contact_members JOIN contacts USING (contact_id) GROUP BY 1)
 JOIN (SELECT group_id, bool_or(exact) AS exact FROM contact_links JOIN contact_members ON u = contact_id GROUP BY 1) USING (group_id)""",
    "exact_members": """SELECT min(asset_id) OVER w AS group_id, asset_id, library_id, width, height, byte_size, sha256(content) AS digest, creation_s, first_value(asset_id) OVER (PARTITION BY library_id, width, height, byte_size, sha256(content) ORDER BY creation_s NULLS LAST, asset_id) AS recommended_keep
 FROM assets WINDOW w AS (PARTITION BY library_id, width, height, byte_size, sha256(content)) QUALIFY count(*) OVER w > 1""",
    "candidates": "SELECT library_id, asset_id, creation_s FROM assets WHERE NOT is_screenshot AND creation_s IS NOT NULL",
    "sessions": """SELECT *, count(*) OVER (PARTITION BY library_id, session_no) AS n, min(creation_s) OVER (PARTITION BY library_id, session_no) AS session_start FROM (
 SELECT *, sum(new) OVER (PARTITION BY library_id ORDER BY creation_s, asset_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (
 SELECT *, CASE WHEN creation_s - lag(creation_s) OVER (PARTITION BY library_id ORDER BY creation_s, asset_id) <= 120 THEN 0 ELSE 1 END AS new FROM candidates WHERE asset_id NOT IN (SELECT asset_id FROM exact_members)))""",
}

_NEEDS = {
    "contacts_1": ["contacts_0"], "contacts_raw": ["contacts_1"], "contacts": ["contacts_raw"], "cells": ["tokens"], "grids": ["cells"], "hashes": ["grids"], "signals": ["tokens"], "groups": ["review_docs"],
    "members": ["groups"], "everything": ["assets", "videos"], "selection": ["everything"], "live": ["everything"], "outcomes": ["everything"], "capacity": ["everything"], "plan": ["selection", "live", "grants"],
    "executed": ["plan", "outcomes"], "phone_edges": ["contacts"], "email_edges": ["contacts"], "exact_edges": ["phone_edges", "email_edges"], "weak_phones": ["contacts"], "weak_emails": ["contacts"], "named": ["contacts"],
    "probable_edges": ["weak_phones", "weak_emails", "named", "exact_edges"], "contact_links": ["exact_edges", "probable_edges"], "contact_reach": ["contact_links"], "contact_members": ["contact_reach"],
    "contact_groups": ["contact_members", "contacts", "contact_links"], "exact_members": ["assets"], "candidates": ["assets"], "sessions": ["candidates", "exact_members"],
}


def sql(views: str, body: str, **own: str) -> str:
    """``body`` as DuckDB SQL after the named ``views`` (by blanks) and what they need, then ``own`` ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in own.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
