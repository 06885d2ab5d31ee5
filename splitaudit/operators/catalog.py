"""The catalog: one row a record, numbered in a total order, with its issues; and its coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitaudit.functions.scalars import alias_width, record_alias

KEYS = ["file_sha256", "patient_group_token", "study_uid_token", "series_uid_token", "sop_uid_token"]
#: Modalities of the primary profile (fixed values).
PRIMARY_MODALITIES = ["CR", "DX"]
ISSUES = "array<struct<category:string,code:string>>"


def _issue(condition: Column, category: str, code: Column | str) -> Column:
    made = F.struct(F.lit(category).alias("category"), (F.lit(code) if isinstance(code, str) else code).alias("code"))
    return F.when(F.coalesce(condition, F.lit(False)), made)


def with_issues(records: DataFrame) -> DataFrame:
    """Adds `supported` and `issues` to records.

    Wants media_type, access_issue (why a record was not opened or probed, or null), hash_failed,
    parse_error, patient_id_status (null where no metadata was parsed), modality and number_of_frames.
    """
    parsed = F.col("patient_id_status").isNotNull()
    listed = F.array(
        _issue(F.col("access_issue").isNotNull(), "unreadable", F.col("access_issue")),
        _issue(F.col("media_type") == "unsupported", "unsupported", "unsupported_file_type"),
        _issue(F.col("hash_failed"), "unreadable", "file_hash_failed"),
        _issue(F.col("parse_error").isNotNull(), "unreadable", F.col("parse_error")),
        _issue(F.col("patient_id_status").isin("missing", "dummy"), "metadata_unavailable", F.concat(F.lit("patient_id_"), F.col("patient_id_status"))),
        _issue(parsed & (F.col("number_of_frames") > 1), "outside_primary_profile", "dicom_multiframe_inventory"),
        _issue(parsed & F.col("modality").isNull(), "outside_primary_profile", "dicom_modality_missing"),
        _issue(parsed & ~F.col("modality").isin(PRIMARY_MODALITIES), "outside_primary_profile", "dicom_modality_outside_primary_profile"),
    )
    return records.withColumn("supported", F.col("media_type").isin("dicom", "raster")).withColumn("issues", F.array_sort(F.array_compact(listed)).cast(ISSUES))


def number_records(records: DataFrame, order: list[Column], keep) -> DataFrame:
    """Adds `alias`, counted from 1 in the given total order.

    Rows are dealt by ranges of the order and sorted in each; a row's number is its place in its
    partition plus the sizes of the partitions before, so no task ever holds all rows.  `keep`
    materialises the sorted rows (they are read twice).
    """
    dealt = records.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = keep(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    offset = F.create_map(*[F.lit(x).cast("long") for item in before.items() for x in item])[part] if before else F.lit(0)
    ordinal = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + offset + 1
    return dealt.withColumn("alias", record_alias(ordinal, alias_width(total))).drop("_place")


def artifact_order() -> list[Column]:
    """Split and namespace without and with case, then path; `ord` settles exact repeats."""
    return [F.coalesce("split_fold", F.lower("split")), F.col("split"), F.coalesce("namespace_fold", F.lower("source_namespace")), F.col("source_namespace"), F.col("path"), F.col("ord")]


@dataclass(frozen=True)
class Coverage:
    declared_split_count: int = 0
    populated_split_count: int = 0
    evaluable_split_count: int = 0
    discovered: int = 0
    supported: int = 0
    hashed: int = 0
    dicom_candidates: int = 0
    dicom_parsed: int = 0
    dicom_identity_incomplete: int = 0
    outside_primary_profile: int = 0
    unsupported: int = 0
    unreadable: int = 0
    issue_counts: tuple[tuple[str, int], ...] = ()


def _has(category: str) -> Column:
    return F.exists("issues", lambda i: i["category"] == category)


def coverage_counts(catalog: DataFrame) -> DataFrame:
    """One row of the catalog's counters, from one aggregate."""
    parsed = F.col("patient_id_status").isNotNull()
    incomplete = F.lit(False)
    for k in KEYS[1:]:
        incomplete = incomplete | F.col(k).isNull()
    evaluable = F.col("file_sha256").isNotNull() | parsed
    return catalog.agg(
        F.count_distinct("split").alias("populated_split_count"),
        F.count_distinct(F.when(evaluable, F.col("split"))).alias("evaluable_split_count"),
        F.count("*").alias("discovered"),
        F.count_if("supported").alias("supported"),
        F.count_if(F.col("file_sha256").isNotNull()).alias("hashed"),
        F.count_if(F.col("media_type") == "dicom").alias("dicom_candidates"),
        F.count_if(parsed).alias("dicom_parsed"),
        F.count_if(parsed & incomplete).alias("dicom_identity_incomplete"),
        F.count_if(_has("outside_primary_profile")).alias("outside_primary_profile"),
        F.count_if(F.col("media_type") == "unsupported").alias("unsupported"),
        F.count_if(_has("unreadable")).alias("unreadable"),
    )


def issue_counts(catalog: DataFrame) -> DataFrame:
    """Issues (not records) by code."""
    return catalog.select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("count"))


def dataset_issues(declared: int, populated: int, evaluable: int) -> dict[str, int]:
    """Issue codes of the dataset as a whole, with their counts."""
    found = {"insufficient_split_count": int(declared < 2), "empty_declared_split": declared - populated, "insufficient_evaluable_splits": int(evaluable < 2)}
    return {code: n for code, n in found.items() if n > 0}


def coverage(catalog: DataFrame, declared: list[str]) -> Coverage:
    row = coverage_counts(catalog).first().asDict()
    counts = {r["code"]: r["count"] for r in issue_counts(catalog).collect()}
    populated = row["populated_split_count"]
    counts |= dataset_issues(len(declared), populated, row["evaluable_split_count"])
    return Coverage(declared_split_count=len(declared), issue_counts=tuple(sorted(counts.items())), **row)
