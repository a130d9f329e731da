"""What comes from outside, on any table: cached answers, credits, items by id, papers, class probabilities, and replies that lack keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.operators.ranks import ranked_in
from groundwell.operators.retrieval import small


def cached(lookups: DataFrame, entries: DataFrame, version: int) -> DataFrame:
    """lookups (key and any columns) with hit: whether the last of the key's entries (key, at, version) has this version. A null key hits nothing."""
    last = entries.groupBy("key").agg(F.max_by("version", "at").alias("_version"))
    known = last.where(F.col("_version") == version).select("key", F.lit(True).alias("hit"))
    return lookups.join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rate(hits: Column, lookups: Column) -> Column:
    """0 without lookups."""
    return F.round(F.coalesce(F.try_divide(hits, lookups), F.lit(0.0)), 6)


def daily_cap(monthly: Column, configured: Column) -> Column:
    """Credits of a day: what is configured, or else a thirtieth of the month's; one at least."""
    return F.greatest(F.lit(1), F.coalesce(configured, F.floor(monthly / 30))).cast("long")


def by_id(items: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Items whose key is among the wanted ones (each item once, however often it is wanted); what isn't there is left out."""
    return items.join(small(wanted.select(key).distinct()), key, "left_semi")


def papers(found: DataFrame, group: str, order: str) -> DataFrame:
    """found (title, body, group, order) as papers with a score: 1 over the place in the group. Without a title and a text a row isn't a paper, and takes no place."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ranked = ranked_in(found.where(~(blank("title") & blank("body"))), group, order)
    return ranked.withColumn("score", F.round(1 / F.col("rank"), 6)).drop("rank")


def class_probability(logits: Column, which: Column) -> Column:
    """The softmax of a class (from 0) of an array of logits; a model with one output gives it as it is, and a class that isn't there has 0. Null without logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    p = F.get(e, which) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logits) == 1, F.get(logits, F.lit(0))).when(F.size(logits) > 1, F.coalesce(p, F.lit(0.0)))


def missing_keys(reply: Column, required: list[str]) -> Column:
    """The required keys, in their order, that a JSON object lacks; all of them where it isn't one. A key with a null value is there."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(reply), F.array().cast("array<string>")))
