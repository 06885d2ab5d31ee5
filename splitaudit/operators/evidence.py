"""Findings and detector coverage of a catalog, for any set of rules at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitaudit.functions.scalars import component_id
from splitaudit.operators.rules import VERSION, Rule

SPLITS, ALIASES = "splits", "record_aliases"


def _keys(catalog: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, key, split, alias) of all records with evidence: one scan for all rules."""
    keyed = catalog.select("alias", "split", *[F.when(r.evaluated(), F.col(r.key)).alias(r.rule_id) for r in rules])
    return keyed.unpivot(["alias", "split"], [r.rule_id for r in rules], "rule_id", "key").where("key is not null")


def findings(catalog: DataFrame, rules: list[Rule], splits: list[str]) -> DataFrame:
    """A row for each rule and key that two splits or more share, in no particular order.

    Which keys cross splits is settled by a minimum and maximum of split numbers (integers,
    combined before the shuffle); only members of those keys are then gathered.
    """
    long = _keys(catalog, rules)
    number = F.create_map(*[F.lit(x) for i, s in enumerate(splits) for x in (s, i)])[F.col("split")] if splits else F.lit(0)
    crossing = long.groupBy("rule_id", "key").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo <> hi").select("rule_id", "key")
    members = long.join(crossing, ["rule_id", "key"], "left_semi")
    grouped = members.groupBy("rule_id", "key").agg(F.array_sort(F.collect_set("split")).alias(SPLITS), F.array_sort(F.collect_list("alias")).alias(ALIASES))
    text = lambda field: F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, getattr(r, field))])[F.col("rule_id")]
    observed = reduce(lambda otherwise, r: F.when(F.col("rule_id") == r.rule_id, F.format_string(r.observed, F.size(ALIASES), F.size(SPLITS))).otherwise(otherwise), rules, F.lit(None))
    return grouped.select(
        "rule_id",
        F.lit(VERSION).alias("rule_version"),
        text("category").alias("category"),
        text("strength").alias("evidence_strength"),
        component_id(F.col("rule_id"), F.col(ALIASES)).alias("component_id"),
        SPLITS,
        ALIASES,
        observed.alias("observed_fact"),
        *[text(f).alias(f) for f in ("method", "explanation", "limitation", "recommendation")],
    )


def ordered(found: DataFrame) -> DataFrame:
    """Findings in the order in which they are reported."""
    return found.orderBy("rule_id", SPLITS, ALIASES, "component_id")


def detector_coverage(catalog: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule, also where nothing is eligible, in the order given."""
    per_rule = [F.struct(F.lit(i).alias("rule_ord"), F.lit(r.rule_id).alias("detector_id"), r.eligible().alias("eligible"), r.evaluated().alias("evaluated")) for i, r in enumerate(rules)]
    long = catalog.select("split", F.inline(F.array(*per_rule)))
    counted = long.groupBy("rule_ord", "detector_id").agg(
        F.count_if("eligible").alias("eligible_records"),
        F.count_if("evaluated").alias("evaluated_records"),
        F.count_if(F.col("eligible") & ~F.col("evaluated")).alias("unavailable_records"),
        F.array_sort(F.collect_set(F.when(F.col("eligible"), F.col("split")))).alias("eligible_splits"),
        F.array_sort(F.collect_set(F.when(F.col("evaluated"), F.col("split")))).alias("evaluated_splits"),
    )
    dim = catalog.sparkSession.createDataFrame([(i, r.rule_id) for i, r in enumerate(rules)], "rule_ord int, detector_id string")
    reasons = reason_counts(catalog, rules).groupBy("detector_id").agg(F.array_sort(F.collect_list(F.struct("reason", "count"))).alias("reason_counts"))
    none = F.array().cast("array<string>")
    out = dim.join(F.broadcast(counted.drop("rule_ord")), "detector_id", "left").join(F.broadcast(reasons), "detector_id", "left")
    return out.select(
        "rule_ord",
        "detector_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("eligible_records", "evaluated_records", "unavailable_records")],
        *[F.coalesce(c, none).alias(c) for c in ("eligible_splits", "evaluated_splits")],
        F.coalesce("reason_counts", F.array().cast("array<struct<reason:string,count:bigint>>")).alias("reason_counts"),
    ).orderBy("rule_ord")


def reason_counts(catalog: DataFrame, rules: list[Rule]) -> DataFrame:
    """(detector_id, reason, count): why eligible records had no evidence."""

    def of(rule: Rule):
        return F.transform(rule.reasons(), lambda x: F.struct(F.lit(rule.rule_id).alias("detector_id"), x.alias("reason")))

    return catalog.select(F.inline(F.concat(*map(of, rules)))).groupBy("detector_id", "reason").agg(F.count("*").alias("count"))
