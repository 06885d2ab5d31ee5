"""The report against the published schema's keys, patterns and enumerations (fixed values)."""

import re

from pyspark.sql import SparkSession

from splitaudit import EvidenceCategory, Finding, SplitSpec, audit_split_roots
from splitaudit.plans.report import Protected

TOP = {"schema_version", "tool_version", "config_digest", "splits", "finding_status", "coverage_status", "audit_state", "findings", "coverage", "diagnostics", "policy", "provenance"}
CATALOG = {"declared_split_count", "populated_split_count", "evaluable_split_count", "discovered", "supported", "hashed", "dicom_candidates", "dicom_parsed", "dicom_identity_incomplete", "outside_primary_profile", "unsupported", "unreadable", "issue_counts"}
DETECTOR = {"detector_id", "eligible_records", "evaluated_records", "unavailable_records", "eligible_splits", "evaluated_splits", "reason_counts"}
FINDING = {"rule_id", "rule_version", "category", "evidence_strength", "component_id", "splits", "record_aliases", "observed_fact", "method", "explanation", "limitation", "recommendation"}
POLICY = {"policy_id", "policy_version", "finding_status", "coverage_status", "audit_state", "exit_code", "summary"}
OUTCOMES = {
    ("no_findings", "complete", "complete_no_findings", 0),
    ("potential_risk_detected", "complete", "complete_with_findings", 1),
    ("no_findings", "partial", "partial", 3),
    ("potential_risk_detected", "partial", "partial", 1),
    ("no_findings", "inconclusive", "inconclusive", 3),
    ("potential_risk_detected", "inconclusive", "inconclusive", 1),
    ("no_findings", "operational_error", "operational_error", 2),
    ("potential_risk_detected", "operational_error", "operational_error", 2),
}


def holds(report):
    assert set(report) - {"record_paths"} == TOP and report["schema_version"] == "1.0.0" and re.fullmatch("[0-9a-f]{64}", report["config_digest"])
    assert set(report["coverage"]) == {"catalog", "detectors"} and set(report["coverage"]["catalog"]) == CATALOG
    assert all(set(x) == {"code", "count"} for x in report["coverage"]["catalog"]["issue_counts"])
    for d in report["coverage"]["detectors"]:
        assert set(d) == DETECTOR and re.fullmatch("ML[0-9]{3}", d["detector_id"]) and all(set(x) == {"reason", "count"} for x in d["reason_counts"])
    for f in report["findings"]:
        assert set(f) == FINDING and re.fullmatch("component-[0-9a-f]{16}", f["component_id"]) and f["category"] in {c.value for c in EvidenceCategory}
        assert len(set(f["splits"])) == len(f["splits"]) >= 2 and len(f["record_aliases"]) >= 2 and all(re.fullmatch("record-[0-9]{6,}", a) for a in f["record_aliases"])
    for d in report["diagnostics"]:
        assert {"code", "severity", "message"} <= set(d) <= {"code", "severity", "message", "record_alias"} and d["severity"] in ("info", "warning", "error")
    p = report["policy"]
    assert set(p) == POLICY and (p["finding_status"], p["coverage_status"], p["audit_state"], p["exit_code"]) in OUTCOMES
    assert all(p[k] == report[k] for k in ("finding_status", "coverage_status", "audit_state")) and bool(report["findings"]) == (p["finding_status"] == "potential_risk_detected")
    assert all(isinstance(v, str) for v in report["provenance"].values())
    for x in report.get("record_paths", []):
        assert set(x) == {"record_alias", "path"}


def test_reports_hold_the_schema(spark: SparkSession, tmp_path):
    for name in ("train", "test", "lone"):
        (tmp_path / name / "deep" / "er").mkdir(parents=True)
    (tmp_path / "train" / "deep" / "a.png").write_bytes(b"same")
    (tmp_path / "test" / "deep" / "er" / "b.png").write_bytes(b"same")
    (tmp_path / "test" / "notes.txt").write_bytes(b"text")
    (tmp_path / "lone" / "c.png").write_bytes(b"other")
    cases = [("train", "test"), ("train", "lone"), ("lone",), ("train", "absent")]
    for names in cases:
        result = audit_split_roots([SplitSpec(n, tmp_path / n) for n in names], spark=spark)
        holds(result.to_dict(include_paths=True))
        if names == cases[0]:
            (found,) = result.findings
            assert isinstance(found, Finding) and found.category is EvidenceCategory.FILE_CONTENT and found.splits == ("test", "train")
            assert [x["path"].rsplit("/", 1)[1] for x in result.to_dict(include_paths=True)["record_paths"]] == ["b.png", "notes.txt", "a.png"]


def test_what_is_protected(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x")
    (tmp_path / "alias").hardlink_to(tmp_path / "in" / "a")
    (tmp_path / "link").symlink_to(tmp_path / "in")
    guard = Protected([tmp_path / "in" / "a"], [tmp_path / "in"])
    assert all(guard.covers(tmp_path / p) for p in ("in/a", "in/new", "alias", "link/new", "in/x/y")) and not guard.covers(tmp_path / "out")
