"""Embedding near-duplicates: an exact cosine self-join by PCA-ordered tiles.

Vectors are rotated to principal axes, which puts most of their length into the leading
coordinates.  A k-d tree over leading coordinates cuts space into tiles.  Unit vectors with
cosine >= t lie within r = sqrt(2 - 2t), so a vector can link only into tiles whose box is
within r of it.  Of two tiles that are near each other the one that is less than half the way round
ahead of the other takes its visitors, which meets each pair once and gives every tile as many.
In a tile, products of leading coordinates are accumulated block by block; what remains is
bounded by the product of the suffix norms, and a pair is dropped once its sum and that bound
cannot reach t.  The pairs left are decided by the unrotated vectors in double precision.

Scale: equal vectors are one class with a weight, found by a digest with a combined
aggregate, so copies cost nothing further.  Rotation and tree come from a bounded sample; a
count of all vectors a leaf then cuts crowded leaves into tiles of at most about `TILE_BYTES`, so what a
task keeps does not grow with the data; visitors stream.  A vector visits at most half the tiles, as
few of them as the data allow: where the leading coordinates do not separate it (isotropic vectors), that
is tiles / 2 copies of it, so tiles are made as large as memory and parallel work let them be.
Link counts are summed and components unioned inside the tile: a
task puts out one row for each linked vector, never pairs.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, shuffle_partitions, tidy

#: What a tile's residents take at most, and the least rows for which a tile is made to share work.
TILE_BYTES, LEAST_ROWS = 24 << 20, 4096
#: Sampled vectors for rotation and tree: so many for each leaf, at most SAMPLE_ROWS.
SAMPLE_PER_LEAF, SAMPLE_ROWS = 32, 65_536
#: Leading coordinates that the tree may split.
SPLIT_DIMS = 8
#: Rows of visitors and of residents in one product.
BLOCK_ROWS, RESIDENT_ROWS = 1024, 4096


def _unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of the blobs, which hold single or double precision."""
    x = np.frombuffer(b"".join(blobs), dtype="<f4" if len(blobs[0]) == 4 * dim else "<f8").reshape(len(blobs), dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither over- nor underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """k-d tree over leading rotated coordinates; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        dim = sample.shape[1] if sample.ndim == 2 else 0
        cov = sample.T @ sample / max(1, len(sample)) if dim else np.zeros((0, 0))
        values, vectors = np.linalg.eigh(cov) if dim else (np.zeros(0), np.zeros((0, 0)))
        self.rotation = vectors[:, np.argsort(-values)]
        self.dims = min(SPLIT_DIMS, dim)
        self.lows: list[np.ndarray] = []
        self.highs: list[np.ndarray] = []
        self.root = self._grow(sample @ self.rotation[:, : self.dims] if dim else sample, leaves, np.full(self.dims, -np.inf), np.full(self.dims, np.inf))
        self.low, self.high = np.array(self.lows), np.array(self.highs)

    def _grow(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray):
        if leaves > 1 and len(points) >= 4:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            left = leaves // 2
            at = float(np.quantile(points[:, axis], left / leaves))
            side = points[:, axis] < at
            if 0 < side.sum() < len(points):
                mid_high, mid_low = high.copy(), low.copy()
                mid_high[axis] = mid_low[axis] = at
                return (axis, at, self._grow(points[side], left, low, mid_high), self._grow(points[~side], leaves - left, mid_low, high))
        self.lows.append(low)
        self.highs.append(high)
        return len(self.lows) - 1

    def homes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            else:
                side = x[rows, node[0]] < node[1]
                todo += [(node[2], rows[side]), (node[3], rows[~side])]
        return out

    def visits(self, x: np.ndarray, radius: float):
        """(row, leaf) of each leaf whose box is within the radius."""
        todo = [(self.root, np.arange(len(x)), np.zeros_like(x))]
        rows_out, leaves_out = [], []
        while todo:  # squared distance to a box: the gap in each split coordinate
            node, rows, gap = todo.pop()
            near = (gap * gap).sum(axis=1) <= radius * radius
            rows, gap = rows[near], gap[near]
            if not len(rows):
                continue
            if isinstance(node, int):
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), node, dtype=np.int32))
                continue
            axis, at, left, right = node
            off = x[rows, axis] - at
            gap_left, gap_right = gap.copy(), gap
            gap_left[:, axis] = np.maximum(gap_left[:, axis], off)
            gap_right[:, axis] = np.maximum(gap_right[:, axis], -off)
            todo += [(left, rows, gap_left), (right, rows, gap_right)]
        if not rows_out:
            return np.empty(0, dtype=int), np.empty(0, dtype=np.int32)
        return np.concatenate(rows_out), np.concatenate(leaves_out)


class Tiles:
    """Tiles of a tree's leaves: tiles offset[leaf] to offset[leaf + 1] share a leaf."""

    def __init__(self, tree: Tree, counts: np.ndarray, tile_rows: int) -> None:
        self.tree = tree
        self.offset = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // tile_rows)))])
        self.total = int(self.offset[-1])

    def homes(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        leaf = self.tree.homes(x)
        share = (self.offset[leaf + 1] - self.offset[leaf]).astype(np.uint64)
        return self.offset[leaf] + ((number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % share).astype(np.int64)

    def visits(self, x: np.ndarray, homes: np.ndarray, radius: float):
        """(row, tile) of each near tile that takes visitors from the row's own."""
        row, leaf = self.tree.visits(x, radius)
        n = self.offset[leaf + 1] - self.offset[leaf]
        row = np.repeat(row, n)
        tile = np.repeat(self.offset[leaf] - np.cumsum(n) + n, n) + np.arange(len(row))
        ahead = (tile - homes[row]) % self.total
        takes = (ahead > 0) & ((2 * ahead < self.total) | ((2 * ahead == self.total) & (tile > homes[row])))
        return row[takes], tile[takes]


class Tile:
    """Residents of one tile, and what their links with each other and with visitors add up to."""

    def __init__(self, tree: Tree, threshold: float) -> None:
        self.tree, self.threshold = tree, threshold
        self.ids: list[int] = []
        self.parent: dict[int, int] = {}
        self.degree: dict[int, int] = {}

    def _root(self, i: int) -> int:
        while (p := self.parent.setdefault(i, i)) != i:
            self.parent[i] = self.parent[p]
            i = self.parent[p]
        return i

    def _union(self, a: int, b: int) -> None:
        a, b = self._root(a), self._root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def _ready(self, unit: np.ndarray):
        """The rotated vectors, where products stop to be judged, and the suffix norms there."""
        y = (unit @ self.tree.rotation).astype(np.float32)
        dim = y.shape[1]
        stops = sorted({max(1, dim // 4), max(1, dim // 2), dim})
        tails = np.stack([np.sqrt(np.maximum(0.0, 1 - (y[:, :m].astype(np.float64) ** 2).sum(axis=1))) for m in stops]).astype(np.float32)
        return y, stops, tails

    def settle(self, ids: np.ndarray, weights: np.ndarray, unit: np.ndarray) -> None:
        """Take all residents, and link them with each other."""
        self.ids, self.weights, self.unit, self.mine = ids, weights, unit, self._ready(unit)
        y, stops, tails = self.mine
        for lo in range(0, len(ids), BLOCK_ROWS):
            part = slice(lo, lo + BLOCK_ROWS)
            self._meet(ids[part], weights[part], unit[part], (y[part], stops, tails[:, part]), after=lo)

    def visit(self, ids: np.ndarray, weights: np.ndarray, unit: np.ndarray) -> None:
        for lo in range(0, len(ids), BLOCK_ROWS):
            part = slice(lo, lo + BLOCK_ROWS)
            self._meet(ids[part], weights[part], unit[part], self._ready(unit[part]), after=None)

    def _meet(self, ids, weights, unit, theirs, after: int | None) -> None:
        """Links of a block with the residents; `after` is the block's own place among them."""
        for first in range(after or 0, len(self.ids), RESIDENT_ROWS):
            part = slice(first, first + RESIDENT_ROWS)
            rows, cols = self._able(theirs, part, None if after is None else first - after)
            mine, mine_weights, mine_unit = self.ids[part], self.weights[part], self.unit[part]
            for lo in range(0, len(rows), 1 << 16):
                r, c = rows[lo : lo + (1 << 16)], cols[lo : lo + (1 << 16)]
                link = np.einsum("ij,ij->i", unit[r], mine_unit[c]) >= self.threshold
                r, c = r[link], c[link]
                if not len(r):
                    continue
                for own, other, w in ((ids, r, mine_weights[c]), (mine, c, weights[r])):
                    counts = np.bincount(other, weights=w)
                    for i in np.flatnonzero(counts).tolist():
                        k = int(own[i])
                        self.degree[k] = self.degree.get(k, 0) + int(counts[i])
                forest = _forest(r, c + len(ids), len(ids) + len(mine))
                names = np.concatenate([ids, mine])
                for i in np.unique(np.concatenate([r, c + len(ids)])).tolist():
                    self._union(int(names[i]), int(names[forest[i]]))

    def _able(self, theirs, part: slice, ahead: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that leading coordinates do not rule out; with `ahead` only those after the block's own rows."""
        a, stops, a_tails = theirs
        b, _, b_tails = self.mine
        b, b_tails = b[part], b_tails[:, part]
        total = np.zeros((len(a), len(b)), dtype=np.float32)
        done = 0
        need = np.float32(self.threshold - 1e-4)  # single precision only rules out
        for m, s, t in zip(stops, a_tails, b_tails, strict=True):
            total += a[:, done:m] @ b[:, done:m].T
            done = m
            able = total + np.outer(s, t) >= need
            if ahead is not None:
                able &= np.arange(len(b))[None, :] + ahead > np.arange(len(a))[:, None]
            n = int(np.count_nonzero(able))
            if not n or m == stops[-1] or n <= able.size // 64:
                return np.nonzero(able)
        raise AssertionError

    def rows(self):
        for i, n in self.degree.items():
            yield i, n, self._root(i)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A component label for each of n nodes of an edge list: least labels are passed on until nothing changes."""
    label = np.arange(n)
    while True:
        old = label
        label = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, tile_rows: int | None = None) -> DataFrame:
    """A row for each input row: the key, n_links, component_id and kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing:
    n_links 0, their own component, kept.  So do vectors under a null key, whose component_id
    is null and which are kept.  Vectors of different lengths never link.  Equal vectors link
    with each other; rows that repeat a key are vectors of their own, with links of their own.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("the key must be an integer")
    single = vectors.schema[embedding].dataType.elementType.simpleString() == "float"
    width = 4 if single else 8

    def digest(batches):
        for batch in batches:
            column = batch.column("e")
            digests, blobs = [], []
            for i in range(batch.num_rows):
                x = column[i].values
                blob = mark = None
                if x is not None and len(x) and not x.null_count:
                    v = x.to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8") + 0.0
                    if np.isfinite(v).all() and v.any():
                        blob = v.tobytes()
                        mark = hashlib.blake2b(blob, digest_size=16).digest()
                digests.append(mark)
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["k", "digest", "v"])

    own = vectors.select(F.col(key).cast("long").alias("k"), F.col(embedding).alias("e")).mapInArrow(tidy(digest), "k long, digest binary, v binary")
    classes = own.where("k is not null and digest is not null").groupBy("digest").agg(F.min("k").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("dim", (F.octet_length("v") / width).cast("int")).withColumn("c", F.monotonically_increasing_id()), "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    partitions = shuffle_partitions(spark)
    parts = []
    for dim, n in sorted(sizes.items()):
        most = tile_rows or max(256, TILE_BYTES // (12 * dim))
        rows = tile_rows or min(most, max(LEAST_ROWS, -(-n // partitions)))
        leaves = min(SAMPLE_ROWS // SAMPLE_PER_LEAF, -(-n // rows))
        share = min(1.0, max(2048, SAMPLE_PER_LEAF * leaves) / n)
        mine = classes.where(F.col("dim") == dim).select("c", "w", "v", "digest")
        drawn = mine.where((F.xxhash64("digest").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < share).select("digest", "v").collect()
        sample = _unit([bytes(r["v"]) for r in sorted(drawn)], dim) if drawn else np.zeros((0, dim))
        tree = Tree(sample, leaves)
        counts = _count_homes(mine, spark.sparkContext.broadcast(tree), dim) if leaves > 1 else np.array([n])
        parts.append(_links(mine.drop("digest"), spark.sparkContext.broadcast(Tiles(tree, counts, most)), dim, threshold, partitions))
    if not parts:
        linked = classes.select("digest", "w", F.lit(0).cast("long").alias("deg"), F.col("rep").alias("component"))
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = cut(found, "links")
        degrees = found.groupBy("c").agg(F.sum("n").alias("deg"))
        comps = components(found, "c", "root").select(F.col("node").alias("c"), "component")
        joined = classes.select("digest", "rep", "w", "c").join(degrees, "c", "left").join(comps, "c", "left").withColumn("component", F.coalesce("component", "c"))
        least = joined.groupBy("component").agg(F.min("rep").alias("least"))
        linked = joined.join(least, "component").select("digest", "w", F.coalesce("deg", F.lit(0)).alias("deg"), F.col("least").alias("component"))
    out = own.select("k", F.when(F.col("k").isNotNull(), F.col("digest")).alias("digest")).join(linked, "digest", "left")
    comp = F.coalesce("component", "k")
    return out.select(
        F.col("k").cast(kind).alias(key),
        F.coalesce(F.col("w") - 1 + F.col("deg"), F.lit(0)).cast("long").alias("n_links"),
        comp.cast("long").alias("component_id"),
        F.coalesce(F.col("k") == comp, F.lit(True)).alias("kept"),
    )


def _rotated(batch: pa.RecordBatch, tree: Tree, dim: int):
    """(slice, leading rotated coordinates) of a batch's vectors, some at a time."""
    for lo in range(0, batch.num_rows, 4096):
        part = batch.slice(lo, 4096)
        yield part, _unit(part.column("v").to_pylist(), dim) @ tree.rotation[:, : tree.dims]


def _count_homes(classes: DataFrame, tree, dim: int) -> np.ndarray:
    """Vectors of each leaf."""

    def run(batches):
        total = np.zeros(len(tree.value.low), dtype=np.int64)
        for batch in batches:
            for _, x in _rotated(batch, tree.value, dim):
                total += np.bincount(tree.value.homes(x), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["leaf", "n"])

    counts = np.zeros(len(tree.value.low), dtype=np.int64)
    for r in classes.select("v").mapInArrow(tidy(run), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]] = r["n"]
    return counts


def _links(classes: DataFrame, tiles, dim: int, threshold: float, partitions: int) -> DataFrame:
    """(c, n, root): what each tile adds to a class's links, and its component there."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def deal(batches):
        t = tiles.value
        for batch in batches:
            for part, x in _rotated(batch, t.tree, dim):
                homes = t.homes(x, part.column("c").to_numpy())
                rows, near = t.visits(x, homes, radius)
                every = np.concatenate([np.arange(len(x)), rows])
                tile, visitor = np.concatenate([homes, near]), np.arange(len(every)) >= len(x)
                for lo in range(0, len(every), 4096):  # copies of a vector do not pile up in one batch
                    take = pa.array(every[lo : lo + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(tile[lo : lo + 4096]), pa.array(visitor[lo : lo + 4096]), *(part.column(c).take(take) for c in ("c", "w", "v"))], names=["tile", "visitor", "c", "w", "v"])

    def meet(batches):
        now, tile, residents = None, None, []

        def close():
            if residents:
                settle()
            found = list(tile.rows()) if tile is not None else []
            columns = zip(*found, strict=True) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c", "n", "root"])

        def settle():
            ids, weights, blobs = (list(itertools.chain.from_iterable(r[k] for r in residents)) for k in range(3))
            residents.clear()
            tile.settle(np.array(ids), np.array(weights), _unit(blobs, dim))

        for batch in batches:
            tiles_, visitors = batch.column("tile").to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False)
            marks = tiles_ * 2 + visitors
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now != tiles_[a]:
                    if tile is not None:
                        yield close()
                    now, tile = tiles_[a], Tile(tiles.value.tree, threshold)
                cols = [batch.column(c).slice(a, b - a).to_pylist() for c in ("c", "w", "v")]
                if not visitors[a]:
                    residents.append(cols)
                else:
                    if residents:
                        settle()
                    if len(tile.ids):
                        tile.visit(np.array(cols[0]), np.array(cols[1]), _unit(cols[2], dim))
        if tile is not None:
            yield close()

    dealt = classes.mapInArrow(tidy(deal), "tile long, visitor boolean, c long, w long, v binary")
    n = max(1, min(tiles.value.total, max(partitions, tiles.value.total // 16)))
    return dealt.repartitionById(n, F.pmod(F.col("tile"), F.lit(n)).cast("int")).sortWithinPartitions("tile", "visitor").mapInArrow(tidy(meet), "c long, n long, root long")
