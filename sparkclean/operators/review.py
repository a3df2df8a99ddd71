"""Selection state of reviewed groups, orders, previews and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ["photo", "screenshot", "video", "contact"]


def effective_keep(user: str = "user_keep", recommended: str = "recommended_keep") -> Column:
    return F.coalesce(user, recommended)


def tier_groups(groups: DataFrame, tier: str) -> DataFrame:
    return groups.where(F.col("tier") == tier)


def selected_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Selected members with their group's row."""
    return members.where("selected").join(groups, "group_id")


def primary_split(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with ``is_primary``."""
    return members.join(groups.select("group_id", "recommended_primary"), "group_id").withColumn("is_primary", F.col("contact_id") == F.col("recommended_primary")).drop("recommended_primary")


def select_all_but_keep(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.drop("selected").join(groups.select("group_id", effective_keep().alias("_keep")), "group_id").withColumn("selected", F.col("asset_id") != F.col("_keep")).drop("_keep")


def deselect_all(members: DataFrame) -> DataFrame:
    return members.withColumn("selected", F.lit(False))


def override_keeps(groups: DataFrame, members: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members after ``choices`` (``group_id``, ``asset_id``): a chosen member is the keep and not selected.

    A choice that is no member of its group is ignored; of several the smallest id counts.
    """
    valid = choices.join(members.select("group_id", "asset_id"), ["group_id", "asset_id"], "left_semi").groupBy("group_id").agg(F.min("asset_id").alias("_choice"))
    groups = groups.join(valid, "group_id", "left").withColumn("user_keep", F.coalesce("_choice", "user_keep")).drop("_choice")
    keeps = groups.select("group_id", effective_keep().alias("_keep"))
    return groups, members.join(keeps, "group_id").withColumn("selected", F.col("selected") & (F.col("asset_id") != F.col("_keep"))).drop("_keep")


def kept_but_selected(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members that are selected although they are the keep; there must be none."""
    return members.where("selected").join(groups.select("group_id", effective_keep().alias("asset_id")), ["group_id", "asset_id"], "left_semi")


def replay(log: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, asset_id, selected)`` after a log of ``(seq, group_id, item_id, op)``.

    ``select_all`` and ``deselect_all`` reset a group, ``set_keep`` makes a member the keep and clears it, ``toggle``
    flips a member unless it is the keep then. What names no member is ignored. A group without a keep
    (``recommended_keep`` null) lets every member toggle.

    Only a group's last reset and a member's own last ``set_keep`` matter: what was toggled before the later of the two
    is undone, and until the group's next ``set_keep`` the member is the keep. So each event meets one member, and
    members meet one row of their group.
    """
    named = log.join(members.select("group_id", F.col("asset_id").alias("item_id")), ["group_id", "item_id"], "left_semi")
    resets = log.where("op in ('select_all', 'deselect_all')").groupBy("group_id").agg(F.max(F.struct("seq", "op")).alias("reset"))
    keeps = named.where("op = 'set_keep'").select("group_id", "item_id", "seq")
    keeps = keeps.withColumn("until", F.lead("seq").over(Window.partitionBy("group_id").orderBy("seq")))
    first = keeps.groupBy("group_id").agg(F.min("seq").alias("first"))
    own = keeps.groupBy("group_id", F.col("item_id").alias("asset_id")).agg(F.max(F.struct("seq", "until")).alias("own"))
    facts = members.select("group_id", "asset_id").join(groups.select("group_id", "recommended_keep"), "group_id", "left")
    facts = facts.join(resets, "group_id", "left").join(first, "group_id", "left").join(own, ["group_id", "asset_id"], "left")
    recommended = F.coalesce(F.col("recommended_keep") == F.col("asset_id"), F.lit(False))
    kept = F.col("own").isNotNull() | recommended
    until = F.when(F.col("own").isNotNull(), F.col("own.until")).otherwise(F.col("first"))  # null: to the end of the log
    facts = facts.select(
        "group_id", "asset_id", F.greatest("reset.seq", "own.seq").alias("since"), kept.alias("kept"), until.alias("until"), F.col("reset.op").alias("op"), F.col("reset.seq").alias("at"), F.col("own.seq").alias("own_at"),
    )
    is_keep = lambda seq: F.col("kept") & (F.col("until").isNull() | (F.col("until") > seq))
    toggles = named.where("op = 'toggle'").select("group_id", F.col("item_id").alias("asset_id"), "seq").join(facts, ["group_id", "asset_id"])
    flips = toggles.where((F.col("since").isNull() | (F.col("seq") > F.col("since"))) & ~is_keep(F.col("seq"))).groupBy("group_id", "asset_id").agg(F.count("*").alias("flips"))
    cleared = F.coalesce(F.col("own_at") > F.col("at"), F.lit(False))
    base = F.coalesce(F.col("op") == "select_all", F.lit(False)) & ~cleared & ~is_keep(F.col("at"))
    return facts.join(flips, ["group_id", "asset_id"], "left").select("group_id", "asset_id", (base != (F.coalesce("flips", F.lit(0)) % 2 == 1)).alias("selected"))


def ranked(rows: DataFrame, item: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in a total order; ties by ``item``.

    Rows are sorted by range over the cluster; a rank is the number of rows in the ranges before plus the place inside.
    """
    from ..storage import stage

    by = [*order, F.col(item).asc()]
    parts = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.withColumn("_inside", inside).join(before, "_part").withColumn("rank", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def largest_first(videos: DataFrame, item: str = "asset_id") -> DataFrame:
    return ranked(videos, item, F.desc("byte_size"))


def newest_first(rows: DataFrame, item: str = "asset_id", ts: str = "creation_ts") -> DataFrame:
    """Newest first, undated last, ties by id."""
    return ranked(rows, item, F.desc_nulls_last(ts))


def preview(members: DataFrame, item: str = "asset_id", pos: str = "member_pos", n: int = 3) -> DataFrame:
    """The first ``n`` members of each group with their ``rank``."""
    order = Window.partitionBy("group_id").orderBy(pos, item)
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def recoverable_by_group(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.sum(F.when(F.col("selected"), F.coalesce("byte_size", F.lit(0))).otherwise(0)).alias("recoverable_bytes"))


def recoverable_total(selected: DataFrame) -> DataFrame:
    """One row over ``(category, item_id, byte_size)``: bytes with overlaps counted twice, and without."""
    distinct = selected.groupBy("item_id").agg(F.max("byte_size").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("distinct_bytes"))
    return selected.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes")).withColumn("one", F.lit(1)).join(distinct.withColumn("one", F.lit(1)), "one").drop("one")


def recoverable_by_category(selected: DataFrame) -> DataFrame:
    """``(category, recoverable_bytes)`` with every category; contacts free nothing."""
    names = selected.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    sums = selected.where("category <> 'contact'").groupBy("category").agg(F.sum("byte_size").alias("b"))
    return names.join(sums, "category", "left").select("category", F.coalesce("b", F.lit(0)).alias("recoverable_bytes"))


def as_map(by_category: DataFrame) -> DataFrame:
    """One row with a map from category to bytes."""
    return by_category.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "recoverable_bytes")))).alias("recoverable"))


def selected_bytes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.when(F.col("selected"), F.col("byte_size"))), F.lit(0)).alias("selected_bytes"))


def selection_counts(selection: DataFrame) -> DataFrame:
    """Items over the four categories, an item counted once in each, and whether there are none."""
    return selection.select("category", "item_id").distinct().agg(F.count("*").alias("total_items")).withColumn("is_empty", F.col("total_items") == 0)


def dashboard(found: DataFrame, selection: DataFrame) -> DataFrame:
    """``(category, n_groups, n_found, n_selected)`` from ``found`` (category, group_id, item_id) and a selection."""
    names = found.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    groups = found.select("category", "group_id").where("group_id is not null").distinct().groupBy("category").agg(F.count("*").alias("g"))
    items = found.select("category", "item_id").distinct().groupBy("category").agg(F.count("*").alias("f"))
    chosen = selection.select("category", "item_id").distinct().groupBy("category").agg(F.count("*").alias("s"))
    joined = names.join(groups, "category", "left").join(items, "category", "left").join(chosen, "category", "left")
    return joined.select("category", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("g", "n_groups"), ("f", "n_found"), ("s", "n_selected"))])


def media_ids(selection: DataFrame) -> DataFrame:
    """Distinct ids of photos, screenshots and videos."""
    return selection.where("category in ('photo', 'screenshot', 'video')").select("item_id").distinct()


def current_selection(*parts: DataFrame) -> DataFrame:
    """The distinct ``(category, item_id)`` of several selections."""
    whole = parts[0].select("category", "item_id")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("category", "item_id"))
    return whole.distinct()
