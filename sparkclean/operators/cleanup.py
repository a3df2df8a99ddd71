"""From a reviewed selection to a checked plan, the result of running it, and the groups that remain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order in which an id that stands in several categories is reported.
PRECEDENCE = {"photo": 0, "screenshot": 1, "video": 2, "contact": 3}
NOT_CONFIRMED = "Not confirmed by system"


class NothingToDo(ValueError):
    """The plan was not confirmed or the selection is empty."""


def domain_of(category: str = "category") -> Column:
    return F.when(F.col(category) == "contact", "contacts").otherwise("media")


def revalidate(selection: DataFrame, live: DataFrame) -> DataFrame:
    """The selection with ``is_valid``: whether the item is still there."""
    there = live.select("item_id").distinct().withColumn("_there", F.lit(True))
    return selection.join(there, "item_id", "left").withColumn("is_valid", F.coalesce("_there", F.lit(False))).drop("_there")


def permitted(selection: DataFrame, grants: DataFrame) -> DataFrame:
    """The selection with ``is_permitted``: whether its domain may be changed; a domain without a grant may not."""
    usable = grants.groupBy("domain").agg(F.bool_and("usable").alias("_usable"))
    return selection.withColumn("domain", domain_of()).join(usable, "domain", "left").withColumn("is_permitted", F.coalesce("_usable", F.lit(False))).drop("_usable")


def plan(selection: DataFrame, live: DataFrame, grants: DataFrame) -> DataFrame:
    """``(category, item_id, domain, verdict)``: ``execute``, ``staleIdentifier`` or ``permissionRevoked`` for each item."""
    checked = permitted(revalidate(selection.select("category", "item_id").distinct(), live), grants)
    verdict = F.when(~F.col("is_permitted"), "permissionRevoked").when(~F.col("is_valid"), "staleIdentifier").otherwise("execute")
    return checked.select("category", "item_id", "domain", verdict.alias("verdict"))


def still_valid(selection: DataFrame, valid: DataFrame) -> DataFrame:
    """Each category's items among the valid ones."""
    return selection.select("category", "item_id").distinct().join(valid.select("item_id"), "item_id", "left_semi")


def execute(planned: DataFrame, outcomes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``(domain, item_id, confirmed, reason, detail)`` for each distinct item that was executed.

    ``outcomes`` says what the store confirmed; an item it does not confirm failed. ``errors`` (``domain``,
    ``error``) fails a whole domain.
    """
    asked = planned.where("verdict = 'execute'").select("domain", "item_id").distinct()
    said = outcomes.groupBy("item_id").agg(F.bool_or("confirmed").alias("_said"))
    rows = asked.join(said, "item_id", "left")
    if errors is None:
        rows = rows.withColumn("_error", F.lit(None).cast("string"))
    else:
        rows = rows.join(errors.groupBy("domain").agg(F.min("error").alias("_error")), "domain", "left")
    done = F.coalesce("_said", F.lit(False)) & F.col("_error").isNull()
    return rows.select("domain", "item_id", done.alias("confirmed"), F.when(~done, "frameworkError").alias("reason"), F.when(~done, F.coalesce("_error", F.lit(NOT_CONFIRMED))).alias("detail"))


def failure_category(selection: DataFrame) -> DataFrame:
    """``(item_id, category)``: the category of highest precedence that holds the item."""
    rank = F.coalesce(*[F.when(F.col("category") == c, r) for c, r in PRECEDENCE.items()])
    return selection.groupBy("item_id").agg(F.min_by("category", rank).alias("category"))


def failures(planned: DataFrame, executed: DataFrame) -> DataFrame:
    """``(category, item_id, reason, detail)`` of every item that was stale, barred or not confirmed, once each."""
    by_item = failure_category(planned)
    barred = planned.where("verdict <> 'execute'").select("item_id", F.col("verdict").alias("reason"), F.lit(None).cast("string").alias("detail")).distinct()
    failed = executed.where("not confirmed").select("item_id", "reason", "detail")
    return barred.union(failed).join(by_item, "item_id").select("category", "item_id", "reason", "detail")


def bytes_freed(capacity: DataFrame) -> DataFrame:
    """One row from ``(phase, available)``: what became available between ``before`` and ``after``, 0 if either is missing."""
    of = lambda p: F.max(F.when(F.col("phase") == p, F.col("available")))
    return capacity.agg(F.coalesce(F.greatest(F.lit(0), of("after") - of("before")) * F.when(of("after").isNotNull() & of("before").isNotNull(), 1), F.lit(0)).alias("bytes_freed"))


def storage_summary(capacity: DataFrame, recoverable: DataFrame) -> DataFrame:
    """One row from the ``before`` capacity and the one-row ``recoverable``; none without a capacity."""
    row = capacity.where("phase = 'before'").select("total", "available", F.greatest(F.lit(0), F.col("total") - F.col("available")).alias("used"), F.lit(1).alias("one"))
    return row.join(recoverable.withColumn("one", F.lit(1)), "one").drop("one")


def summary(planned: DataFrame, executed: DataFrame) -> DataFrame:
    """``(category, n_requested, n_confirmed, n_failed, is_partial)`` for each requested category."""
    done = executed.where("confirmed").select("item_id", F.lit(1).alias("_done"))
    counts = planned.select("category", "item_id").distinct().join(done, "item_id", "left").groupBy("category").agg(F.count("*").alias("n_requested"), F.count("_done").alias("n_confirmed"))
    failed = F.col("n_requested") - F.col("n_confirmed")
    return counts.select("category", "n_requested", "n_confirmed", failed.alias("n_failed"), ((failed > 0) & (F.col("n_confirmed") > 0)).alias("is_partial"))


def prune(groups: DataFrame, members: DataFrame, deleted: DataFrame, item: str = "asset_id", recommended: str = "recommended_keep") -> tuple[DataFrame, DataFrame]:
    """Groups and members without the ``deleted`` (``item_id``) ones.

    A group of fewer than two dissolves. A user's keep stays if it is alive; a recommended keep that is gone gives way
    to the first member by position; the keep is not selected.
    """
    columns = groups.columns
    alive = members.join(deleted.select(F.col("item_id").alias(item)), item, "left_anti")
    facts = alive.groupBy("group_id").agg(F.count("*").alias("_n"), F.min(F.struct("member_pos", F.col(item).alias("item")))["item"].alias("_first")).where("_n > 1")
    groups = groups.join(facts, "group_id")
    for name in [recommended, "user_keep"] if "user_keep" in groups.columns else [recommended]:
        there = alive.select("group_id", F.col(item).alias(name), F.lit(True).alias("_there"))
        groups = groups.join(there, ["group_id", name], "left").withColumn(name, F.when(F.col("_there"), F.col(name)).otherwise(F.col("_first") if name == recommended else F.lit(None))).drop("_there")
    keep = F.coalesce("user_keep", recommended) if "user_keep" in groups.columns else F.col(recommended)
    keeps = groups.select("group_id", keep.alias("_keep"))
    members = alive.join(keeps, "group_id").withColumn("selected", F.col("selected") & (F.col(item) != F.col("_keep"))).drop("_keep")
    return groups.select(*columns), members


def run_cleanup(selection: DataFrame, live: DataFrame, grants: DataFrame, outcomes: DataFrame, capacity: DataFrame, confirmed: bool) -> dict[str, DataFrame]:
    """The whole cleanup: guards first, then plan, execution, failures, summary and bytes freed."""
    if not confirmed:
        raise NothingToDo("the cleanup was not confirmed")
    if selection.isEmpty():
        raise NothingToDo("the selection is empty")
    planned = plan(selection, live, grants)
    executed = execute(planned, outcomes)
    return {"plan": planned, "executed": executed, "failures": failures(planned, executed), "summary": summary(planned, executed), "bytes_freed": bytes_freed(capacity)}


def first_by_rank(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
