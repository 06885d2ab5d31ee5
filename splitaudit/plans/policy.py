"""What an audit's findings and coverage amount to: a decision table."""

from __future__ import annotations

from dataclasses import dataclass

from splitaudit.operators.catalog import Coverage

POLICY_ID, POLICY_VERSION = "splitaudit.conservative", "1"
#: Statuses, exit codes and wording are part of the report's contract.
_ERROR = "The audit could not be completed because an operational error occurred."
_RISK = "Potential contamination risk detected; review the factual evidence before model training."
_RISK_AND_GAPS = "Potential contamination risk detected, and audit coverage was {}; review both before model training."
_GAPS = "No configured finding was detected, but the audit coverage was {}."
_NOTHING = "No configured finding was detected within the checks and coverage reported by this audit."
EXIT_CLEAN, EXIT_FINDINGS, EXIT_ERROR, EXIT_GAPS = 0, 1, 2, 3


@dataclass(frozen=True)
class Outcome:
    finding_status: str
    coverage_status: str
    audit_state: str
    exit_code: int
    summary: str
    policy_id: str = POLICY_ID
    policy_version: str = POLICY_VERSION


def coverage_status(coverage: Coverage, detectors: list[dict]) -> str:
    """inconclusive, partial or complete."""
    comparable = any(len(d["evaluated_splits"]) > 1 for d in detectors)
    if not comparable or coverage.discovered == 0 or coverage.declared_split_count < 2:
        return "inconclusive"
    gaps = coverage.unsupported + coverage.unreadable + coverage.outside_primary_profile + sum(d["unavailable_records"] for d in detectors)
    return "partial" if gaps or coverage.populated_split_count < coverage.declared_split_count else "complete"


def conservative(findings: int, coverage: Coverage, detectors: list[dict], operational_error: bool = False) -> Outcome:
    """Findings decide the exit code first, then gaps in coverage."""
    status = "potential_risk_detected" if findings else "no_findings"
    if operational_error:
        return Outcome(status, "operational_error", "operational_error", EXIT_ERROR, _ERROR)
    covered = coverage_status(coverage, detectors)
    whole = covered == "complete"
    state = ("complete_with_findings" if findings else "complete_no_findings") if whole else covered
    if findings:
        return Outcome(status, covered, state, EXIT_FINDINGS, _RISK if whole else _RISK_AND_GAPS.format(covered))
    return Outcome(status, covered, state, EXIT_CLEAN if whole else EXIT_GAPS, _NOTHING if whole else _GAPS.format(covered))
