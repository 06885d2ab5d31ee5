"""Split-integrity audits on Spark."""

__version__ = "0.1.0"


def __getattr__(name: str):
    """The public names, loaded on first use (executors import parts of the package only)."""
    from importlib import import_module

    homes = {
        "splitaudit.plans.audit": ("audit", "audit_manifest", "audit_split_roots"),
        "splitaudit.config": ("AuditConfig", "DatasetSpec", "SplitSpec"),
        "splitaudit.plans.report": ("AuditResult", "Diagnostic", "EvidenceCategory", "Finding", "terminal_summary", "write_json"),
        "splitaudit.plans.policy": ("Outcome", "conservative"),
    }
    for home, names in homes.items():
        if name in names:
            return getattr(import_module(home), name)
    raise AttributeError(name)
