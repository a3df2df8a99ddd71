"""Joins of many rows to few facts that stay even when one key holds most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Among how many groups the rows of one key are dealt.
FAN = 64


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], fan: int = FAN) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has each of the ``keys`` once; a null key equals a null key.

    The rows of a key are dealt by the hash of ``by`` among ``fan`` groups, and a fact is copied to the groups that have
    rows; the groups are found by a distinct that combines before it shuffles. Rows without a fact drop out.
    """
    same = lambda a, b, on: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on])
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(fan)).cast("int"))
    asked = dealt.select(*keys, "_deal").distinct()
    more = [c for c in facts.columns if c not in keys]
    known = asked.alias("k").join(facts.alias("f"), same("k", "f", keys)).select("k.*", *[f"f.`{c}`" for c in more])
    both = dealt.alias("r").join(known.alias("k"), same("r", "k", [*keys, "_deal"]))
    return both.select("r.*", *[f"k.`{c}`" for c in more]).drop("_deal")
