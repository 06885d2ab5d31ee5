"""Rows that carry numpy arrays: many small records travel as a few binary values."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy


def pack(*arrays: np.ndarray) -> bytes:
    """Several one-dimensional arrays in one binary value."""
    parts = [bytes([len(arrays)])]
    for x in arrays:
        code = x.dtype.str.encode()
        parts += [bytes([len(code)]), code, len(x).to_bytes(8, "little")]
    return b"".join([*parts, *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    at, kinds = 1, []
    for _ in range(blob[0]):
        n = blob[at]
        kinds.append((np.dtype(blob[at + 1 : at + 1 + n].decode()), int.from_bytes(blob[at + 1 + n : at + 9 + n], "little")))
        at += 9 + n
    out = []
    for kind, n in kinds:
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += n * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the smallest type that holds them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def rows(parts: list[int], kinds: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    """Record batch of (part, kind, blob); SCHEMA is its Spark schema."""
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


SCHEMA = "part int, kind int, blob binary"
#: Bytes of blobs in one record batch.
BATCH_BYTES = 2 << 20


class Sender:
    """Collects rows and gives record batches of bounded size."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, bytes]] = []
        self.bytes = 0

    def add(self, part: int, kind: int, blob: bytes) -> None:
        self.held.append((part, kind, blob))
        self.bytes += len(blob)

    def full(self):
        if self.bytes >= BATCH_BYTES:
            yield from self.rest()

    def rest(self):
        if self.held:
            yield rows(*map(list, zip(*self.held, strict=True)))
        self.held, self.bytes = [], 0


def split_by(part: np.ndarray, n: int):
    """(value, positions) for each value below n that occurs, positions ascending; takes no longer for values that do not occur."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    edges = np.append(np.flatnonzero(np.diff(ordered, prepend=-1)), len(ordered))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(ordered[a]), order[a:b]


#: Partitions that blobs are dealt to at once; beyond, a partition holds several groups, one after the other.
MAX_PARTS = 4096
#: Bytes of small blobs that are gathered before they are cut anew.
RECUT_BYTES = 16 << 20


def whole_groups(n: int) -> int:
    """At least n groups: a number up to `MAX_PARTS`, or a multiple of it."""
    return n if n <= MAX_PARTS else -(-n // MAX_PARTS) * MAX_PARTS


def dealt_to(groups: int) -> int:
    """Parts that a map task deals to where `by_group` cuts its blobs anew."""
    return min(groups, MAX_PARTS)


def cut_by(column: int, mix=None):
    """Deals arrays of equal length by one of them, mixed first if need be."""

    def run(sender: Sender, kind: int, groups: int, blobs: list[bytes]) -> None:
        columns = [np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)]
        by = columns[column].astype(np.uint64)
        for part, at in split_by(((by if mix is None else mix(by)) % np.uint64(groups)).astype(np.int32), groups):
            sender.add(part, kind, pack(*(c[at] for c in columns)))

    return run


def _recut(cuts: dict, groups: int):
    def run(batches):
        sender = Sender()
        held: dict[int, list[bytes]] = {}
        size = 0
        for batch in batches:
            for part, k, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k not in cuts:
                    sender.add(part, k, blob)
                    continue
                held.setdefault(k, []).append(blob)
                size += len(blob)
                if size >= RECUT_BYTES:
                    for kind, some in held.items():
                        cuts[kind](sender, kind, groups, some)
                    held.clear()
                    size = 0
            yield from sender.full()
        for kind, some in held.items():
            cuts[kind](sender, kind, groups, some)
        yield from sender.rest()

    return run


def each(fn):
    """A function of one group's batches, for batches in the order of their groups."""

    def pieces(batches):
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(part, prepend=~part[:1])), len(part)).tolist()
            for a, b in itertools.pairwise(edges):
                yield int(part[a]), batch.slice(a, b - a)

    def run(batches):
        for _, group in itertools.groupby(pieces(batches), key=lambda piece: piece[0]):
            yield from fn(batch for _, batch in group)

    return run


def by_group(sent: DataFrame, groups: int, fn, schema: str, cuts: dict | None = None, ordered: bool = False) -> DataFrame:
    """`fn` over the batches of each group of (part, kind, blob); kinds in ascending order if `ordered`.

    Up to `MAX_PARTS` groups are partitions.  Beyond, a partition holds every group of like remainder: Spark sorts it
    by group, spilling, and groups stream through `fn` one at a time, so partitions and blocks of the shuffle stay
    bounded however many groups there are.  `cuts` names kinds that map tasks deal to `dealt_to(groups)` parts only, with
    a function (sender, kind, groups, blobs) that deals them to groups before the sort; `groups` is then one
    of `whole_groups`.
    """
    if groups <= MAX_PARTS:
        sent = sent.repartitionById(groups, F.col("part"))
        return (sent.sortWithinPartitions("kind") if ordered else sent).mapInArrow(tidy(fn), schema)
    sent = sent.repartitionById(MAX_PARTS, F.col("part") % MAX_PARTS)
    if cuts:
        sent = sent.mapInArrow(tidy(_recut(cuts, groups)), SCHEMA)
    return sent.sortWithinPartitions("part", *(["kind"] if ordered else [])).mapInArrow(tidy(each(fn)), schema)
