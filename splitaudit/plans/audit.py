"""An audit from declared inputs to result: list, inspect, number, detect, decide."""

from __future__ import annotations

import platform
from collections.abc import Callable, Iterable
from pathlib import Path

import pyspark
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from splitaudit import __version__
from splitaudit.config import AuditConfig, DatasetSpec, SplitSpec
from splitaudit.operators import catalog as C
from splitaudit.operators import evidence as E
from splitaudit.operators.rules import BY_ID, DATASET_CODES, MESSAGES, UNKNOWN_MESSAGE
from splitaudit.plans.policy import Outcome, conservative
from splitaudit.plans.report import AuditResult, Diagnostic, Finding
from splitaudit.session import ship
from splitaudit.sources.discovery import DiscoveryError, artifacts
from splitaudit.sources.inspect import Tokenizer, inspect

Policy = Callable[..., Outcome]


def diagnostics_frame(catalog: DataFrame, dataset_codes: Iterable[str] = ()) -> DataFrame:
    """(severity, code, message, record_alias) of all issues, in the order of the report."""
    known = F.create_map(*[F.lit(x) for item in MESSAGES.items() for x in item])
    told = lambda code: F.coalesce(F.try_element_at(known, code), F.lit(UNKNOWN_MESSAGE))
    rows = catalog.select(F.explode("issues").alias("i"), "alias").select(F.lit("warning").alias("severity"), F.col("i.code").alias("code"), told(F.col("i.code")).alias("message"), F.col("alias").alias("record_alias"))
    whole = [("warning", c, MESSAGES[c], None) for c in DATASET_CODES if c in set(dataset_codes)]
    if whole:
        rows = rows.unionByName(catalog.sparkSession.createDataFrame(whole, "severity string, code string, message string, record_alias string"))
    return rows.orderBy("severity", "code", F.coalesce("record_alias", F.lit("")))


def _provenance(spark: SparkSession) -> dict[str, str]:
    return {"java": spark._jvm.java.lang.System.getProperty("java.version"), "python": platform.python_version(), "spark": pyspark.__version__, "splitaudit": __version__}


def _failed(spark: SparkSession, spec: DatasetSpec, config: AuditConfig, policy: Policy, code: str, message: str) -> AuditResult:
    coverage = C.Coverage(issue_counts=((code, 1),))
    return AuditResult(
        tool_version=__version__,
        config_digest=config.digest(),
        splits=tuple(sorted(s.name for s in spec.splits)),
        findings=(),
        catalog_coverage=coverage,
        detector_coverage=(),
        diagnostics=(Diagnostic(code, "error", message),),
        policy_outcome=policy(0, coverage, [], operational_error=True),
        provenance=_provenance(spark),
        **_protected(spec),
    )


def _protected(spec: DatasetSpec) -> dict:
    return {"protected_files": () if spec.manifest is None else (spec.manifest.absolute(),), "protected_roots": tuple(s.root.absolute() for s in spec.splits)}


def audit(spec: DatasetSpec, config: AuditConfig | None = None, policy: Policy = conservative, spark: SparkSession | None = None, key: bytes | None = None) -> AuditResult:
    """Audit one dataset; what stops an audit is a result with exit code 2, not an exception."""
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    config = config or AuditConfig()
    unknown = [i for i in config.enabled_detector_ids if i not in BY_ID]
    if unknown:
        return _failed(spark, spec, config, policy, "unknown_detector_configuration", "The configuration names an unknown detector.")
    try:
        listed, declared = artifacts(spark, spec)
    except DiscoveryError as e:
        return _failed(spark, spec, config, policy, "discovery_failed", f"The declared inputs could not be listed: {e}.")
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.DISK_ONLY))  # files are read once, and tokens stay as they are
        return kept[-1]

    try:
        records = C.with_issues(inspect(listed, config.file_hash_chunk_bytes, Tokenizer(key)))
        catalog = C.number_records(records, C.artifact_order(), keep)
        if declared is None:
            declared = sorted(r["split"] for r in catalog.select("split").distinct().collect())
        rules = [BY_ID[i] for i in config.enabled_detector_ids]
        coverage = C.coverage(catalog, declared)
        detectors = [r.asDict(recursive=True) for r in E.detector_coverage(catalog, rules).drop("rule_ord").collect()]
        found = [r.asDict(recursive=True) for r in E.ordered(E.findings(catalog, rules, declared)).collect()]
        told = diagnostics_frame(catalog, [c for c, _ in coverage.issue_counts]).collect()
        paths = {r["alias"]: bytes(r["path"]) for r in catalog.select("alias", "path").toLocalIterator()}
    except PySparkException as e:
        if DiscoveryError.__name__ not in str(e):
            raise
        return _failed(spark, spec, config, policy, "discovery_failed", "The declared inputs could not be listed: a split folder could not be traversed.")
    finally:
        for df in kept:
            df.unpersist()
    return AuditResult(
        tool_version=__version__,
        config_digest=config.digest(),
        splits=tuple(declared),
        findings=tuple(map(Finding.of, found)),
        catalog_coverage=coverage,
        detector_coverage=tuple(detectors),
        diagnostics=tuple(Diagnostic(r["code"], r["severity"], r["message"], r["record_alias"]) for r in told),
        policy_outcome=policy(len(found), coverage, detectors),
        provenance=_provenance(spark),
        record_paths=paths,
        **_protected(spec),
    )


def audit_manifest(path: str | Path, config: AuditConfig | None = None, **options) -> AuditResult:
    return audit(DatasetSpec.from_manifest(path), config, **options)


def audit_split_roots(splits: Iterable[SplitSpec], config: AuditConfig | None = None, **options) -> AuditResult:
    return audit(DatasetSpec.from_split_roots(splits), config, **options)
