"""What an audit is asked to do: the declared splits and the checks to run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

#: Checks in the order in which they are reported by default (fixed values: part of report and digest).
RULE_IDS = ("ML001", "ML101", "ML102", "ML103", "ML104")


def _label(value: str, what: str) -> str:
    value = value.strip()
    if not value or not value.isprintable():
        raise ValueError(f"{what} must be a printable, non-empty text")
    return value


@dataclass(frozen=True)
class SplitSpec:
    """A named split whose files lie under a local folder."""

    name: str
    root: Path
    source_namespace: str = "local"

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", _label(self.name, "a split's name"))
        object.__setattr__(self, "source_namespace", _label(self.source_namespace, "a source namespace"))
        object.__setattr__(self, "root", Path(self.root).expanduser())


@dataclass(frozen=True)
class DatasetSpec:
    """Either one CSV manifest or some split folders."""

    manifest: Path | None = None
    splits: tuple[SplitSpec, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "splits", tuple(self.splits))
        if self.manifest is not None:
            object.__setattr__(self, "manifest", Path(self.manifest).expanduser())
        if bool(self.splits) == (self.manifest is not None):
            raise ValueError("a dataset is one manifest or one or more split folders")
        if len({s.name for s in self.splits}) < len(self.splits):
            raise ValueError("split names must differ")

    @classmethod
    def from_manifest(cls, path: str | Path) -> DatasetSpec:
        return cls(manifest=Path(path))

    @classmethod
    def from_split_roots(cls, splits: Iterable[SplitSpec]) -> DatasetSpec:
        return cls(splits=tuple(splits))


@dataclass(frozen=True)
class AuditConfig:
    """Settings that change what an audit says; paths are no part of the digest."""

    file_hash_algorithm: str = "sha256"
    file_hash_chunk_bytes: int = 1 << 20
    enabled_detector_ids: tuple[str, ...] = RULE_IDS

    def __post_init__(self) -> None:
        ids = tuple(self.enabled_detector_ids)
        object.__setattr__(self, "enabled_detector_ids", ids)
        if self.file_hash_algorithm != "sha256":
            raise ValueError("files are fingerprinted by sha256 only")
        if self.file_hash_chunk_bytes <= 0:
            raise ValueError("the chunk size must be positive")
        if not ids or len(set(ids)) < len(ids) or not all(i.strip() for i in ids):
            raise ValueError("detector ids must be non-empty and differ, and there must be one at least")

    def digest(self) -> str:
        shown = {k: getattr(self, k) for k in ("enabled_detector_ids", "file_hash_algorithm", "file_hash_chunk_bytes")}
        return hashlib.sha256(json.dumps(shown, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
