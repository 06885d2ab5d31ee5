"""Which files an audit covers: a loss-free listing of split folders and CSV manifests.

Spark's own file listing drops hidden, underscored and empty files and follows links, so the
listing is a Python data source of our own, `split_files`, each entry a row, nothing left out.
The driver lists folders from the top only until there are enough of them for one input partition
each; executors walk these.  Paths travel as file-system bytes, since they need not
be text.  Folders are local to the machine that lists them (or mounted on all).
"""

from __future__ import annotations

import csv
import json
import os
import stat
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from splitaudit.config import DatasetSpec

SCHEMA = "ord long, path binary, split string, source_namespace string, split_fold string, namespace_fold string, access_issue string"
#: Issue codes of entries that are not opened (fixed values).
LINK, MISSING, SPECIAL = "symlink_not_followed", "path_missing", "non_regular_file"


class DiscoveryError(Exception):
    """The declared inputs cannot be listed as a whole; the text holds no path."""


def entry_issue(path: bytes) -> str | None:
    """Why a directory entry is not opened, from its own status."""
    mode = os.lstat(path).st_mode
    if stat.S_ISLNK(mode):
        return LINK
    return None if stat.S_ISREG(mode) else SPECIAL


def check_root(root: bytes) -> None:
    if os.path.islink(root):
        raise DiscoveryError("a split folder is a symbolic link")
    if not os.path.isdir(root):
        raise DiscoveryError("a split folder is not an existing directory")


def walk(root: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(path, issue) of every entry under a folder that is no plain directory, linked ones included."""

    def failed(error: OSError) -> None:
        raise DiscoveryError("a split folder could not be traversed") from error

    for folder, folders, files in os.walk(root, onerror=failed):
        links = {d for d in folders if os.path.islink(os.path.join(folder, d))}
        folders[:] = sorted(set(folders) - links)
        for name in sorted([*links, *files]):
            path = os.path.join(folder, name)
            try:
                yield path, entry_issue(path)
            except OSError as e:
                raise DiscoveryError("a split folder could not be traversed") from e


def entries(folder: bytes) -> tuple[list[tuple[bytes, str | None]], list[bytes]]:
    """(path, issue) of a folder's own entries, and its plain subfolders."""
    try:
        names = sorted(os.listdir(folder))
        paths = [os.path.join(folder, n) for n in names]
        inner = [p for p in paths if os.path.isdir(p) and not os.path.islink(p)]
        return [(p, entry_issue(p)) for p in paths if p not in set(inner)], inner
    except OSError as e:
        raise DiscoveryError("a split folder could not be traversed") from e


def _absolute(path: str | Path) -> bytes:
    return os.fsencode(Path(path).expanduser().absolute())


def manifest_items(manifest: Path) -> list[tuple[bytes, str, str, str | None, bool]]:
    """(path, split, namespace, issue, is a folder) of a manifest's rows, in order."""
    source = Path(manifest).expanduser().absolute()
    if not source.is_file():
        raise DiscoveryError("the manifest is not a readable file")
    try:
        with source.open(encoding="utf-8-sig", newline="") as stream:
            table = csv.DictReader(stream)
            header = {(name or "").strip() for name in table.fieldnames or ()}
            if not {"path", "split"} <= header:
                raise DiscoveryError("the manifest's header lacks path or split")
            return [_manifest_item(source.parent, n, row) for n, row in enumerate(table, 2)]
    except UnicodeError as e:
        raise DiscoveryError("the manifest is not UTF-8 text") from e
    except csv.Error as e:
        raise DiscoveryError("the manifest is not CSV") from e
    except OSError as e:
        raise DiscoveryError("the manifest could not be read") from e


def _manifest_item(base: Path, number: int, row: dict) -> tuple[bytes, str, str, str | None, bool]:
    place, split = ((row.get(c) or "").strip() for c in ("path", "split"))
    namespace = (row.get("source_namespace") or "local").strip()  # white space alone is an error, not a default
    if not (place and split and namespace):
        raise DiscoveryError(f"manifest row {number} lacks a required value")
    if not (split.isprintable() and namespace.isprintable()):
        raise DiscoveryError(f"manifest row {number} has a label that cannot be printed")
    path = _absolute(base / Path(place).expanduser())
    if os.path.islink(path):
        return path, split, namespace, LINK, False
    if not os.path.exists(path):
        return path, split, namespace, MISSING, False
    folder = os.path.isdir(path)
    return path, split, namespace, None if folder or os.path.isfile(path) else SPECIAL, folder


#: Folders that the driver looks for before executors walk them.
WALKS = 256


class _Part(InputPartition):
    """Items to list, of a number of its own; an item is path, split, namespace, issue and how to list it."""

    def __init__(self, number: int, items: list[list]) -> None:
        self.number, self.items = number, items


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.items = json.loads(options["items"])

    def partitions(self) -> list[InputPartition]:
        """Folders alone; files of a manifest in runs."""
        whole = [x for x in self.items if x[4]]
        flat: list[list] = []
        while whole and len(whole) < WALKS:  # take the folders apart, a level at a time
            deeper = []
            for path, split, namespace, issue, _ in whole:
                flat.append([path, split, namespace, issue, "flat"])
                deeper += [[p.hex(), split, namespace, issue, "walk"] for p in entries(bytes.fromhex(path))[1]]
            whole = deeper
        plain = [[*x[:4], "file"] for x in self.items if not x[4]]
        runs = [flat[i : i + 16] for i in range(0, len(flat), 16)] + [[x] for x in whole] + [plain[i : i + 10_000] for i in range(0, len(plain), 10_000)]
        return [_Part(n, run) for n, run in enumerate(runs)] or [_Part(0, [])]

    def read(self, partition: _Part):
        k = 0
        for path, split, namespace, issue, how in partition.items:
            place = bytes.fromhex(path)
            found = walk(place) if how == "walk" else entries(place)[0] if how == "flat" else [(place, issue)]
            for entry, why in found:
                yield ((partition.number << 32) + k, entry, split, namespace, split.casefold(), namespace.casefold(), why)
                k += 1


class SplitFiles(DataSource):
    """`spark.read.format("split_files").option("items", ...)`: see `artifacts`."""

    @classmethod
    def name(cls) -> str:
        return "split_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def artifacts(spark: SparkSession, spec: DatasetSpec) -> tuple[DataFrame, list[str] | None]:
    """All declared files as rows, repeats kept, and the declared splits where folders declare them."""
    if spec.manifest is not None:
        items, declared = manifest_items(spec.manifest), None
    else:
        roots = [(_absolute(s.root), s.name, s.source_namespace) for s in spec.splits]
        items = [(root, name, namespace, None, True) for root, name, namespace in roots]
        declared = sorted(s.name for s in spec.splits)
    for path, _, _, _, folder in items:
        if folder:
            check_root(path)
    spark.dataSource.register(SplitFiles)
    data = json.dumps([[path.hex(), split, namespace, issue, folder] for path, split, namespace, issue, folder in items])
    return spark.read.format("split_files").option("items", data).load(), declared
