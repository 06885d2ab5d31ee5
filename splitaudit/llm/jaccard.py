"""Exact Jaccard self-join over word shingles with adaptive multi-match prefixes.

Sets that overlap in at least a tokens share at least l tokens of their prefixes of length
|x| - a + l, under any common order of tokens.  Tokens are ordered by document frequency, rare
first.  Each set takes the l for which the cost estimated from its prefix's posting lists is
least: the postings that a prefix meets, plus verification of the candidates, of which there
are at most postings / l.  A pair is a candidate if it shares the lesser of its two l within
prefixes of that l; candidates are then verified on whole sets.

Around that join:
* equal sets are one unit, known by a 64-bit hash of the set;
* a first pass in hash order drops units that share fewer than l prefix tokens with anybody,
  so frequencies are counted for the rest only;
* every unit names as hub the least unit of its posting lists that it meets most often.
  Units of one hub, which hold the large groups of near copies, are joined in memory, with posting lists of their
  prefixes that give candidates only between units not yet in one component; so a group gives a
  spanning forest, not its pairs.  Between hubs posting lists give pairs; a list that would give
  `MERGE_POSTINGS` or more makes one hub of its hubs.

Scale: tokens travel as arrays in blocks, dealt by token or by unit into groups sized from
the corpus; beyond `blobs.MAX_PARTS` groups they are dealt in two steps and stream through bounded partitions
group by group.  A map task sends a token that several of its units hold once in the first pass, and
marks one that more than `HOT_UNITS` of them hold as hot in the second: hot tokens come last in the order, so that
prefixes avoid them, and are not gathered to be counted.  A hub of more than `BLOCK_TOKENS` tokens is joined block by
block; a few units of each block then connect the blocks, and what is still outside the hub's largest
component is compared with every block.  Components come from links by alternating stars; nothing but
counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs as B
from . import tokens as K
from .common import components, cut, fresh, shuffle_partitions, texts_of, tidy

#: Prefix tokens that a group should hold on average.
GROUP_TOKENS = 2_000_000
#: Bytes of text that a map task works on at a time.
LOCAL_BYTES = 12 << 20
#: Tokens that a map task gathers before it deals them, so that blocks do not become small.
DEAL_TOKENS = 1_000_000
#: Matches asked for in the first pass, as a share of the set.
FIRST_SHARE = 0.08
#: Cost of verifying a candidate, in postings.
VERIFY_COST = 4.0
#: Pairs of postings between two hubs from which they are joined as one.
MERGE_POSTINGS = 1000
#: Tokens in a block of a hub's units.
BLOCK_TOKENS = 500_000
#: Units of a map task from which a token is hot, and the frequency that hot tokens are given.
HOT_UNITS, HOT = 256, (1 << 32) - 1
#: Units of each block that connect a hub's blocks.
PIVOTS = 8
_INFO, _TOKENS, _ALIVE, _TEXTS, _HITS = 0, 1, 2, 3, 4
_NULL_ID = np.iinfo(np.int64).max


def need(n, num: int, den: int):
    """The least overlap that a set of n tokens has with any set it links with."""
    return -(-num * n // den)


def linked(overlap, n_a, n_b, num: int, den: int):
    return (den + num) * overlap >= num * (n_a + n_b)


def _groups(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return B.whole_groups(max(shuffle_partitions(docs.sparkSession), int(size / 6 * 0.33 / GROUP_TOKENS) + 1))


def _by(h: np.ndarray, groups: int) -> np.ndarray:
    return (h.astype(np.uint64) % np.uint64(groups)).astype(np.int32)


def _units_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def _send(sender: B.Sender, kind: int, groups: int, by: np.ndarray, unit: np.ndarray, per_unit: list[np.ndarray], per_token: list[np.ndarray]) -> None:
    """Tokens to the groups that `by` names; `unit` (ascending) indexes the per-unit arrays."""
    for part, at in B.split_by(_by(by, groups), groups):
        u = unit[at]
        begin = np.flatnonzero(np.diff(u, prepend=-1))
        counts = np.diff(np.append(begin, len(u)))
        sender.add(part, kind, B.pack(B.narrow(counts), *(x[u[begin]] for x in per_unit), *(x[at] for x in per_token)))


def _cut_sent(per_unit: int, by_unit: bool = False):
    """What `_send` sent to its groups by token or unit, for `blobs.by_group`."""

    def run(sender: B.Sender, kind: int, groups: int, blobs: list[bytes]) -> None:
        counts, *columns = (np.concatenate(c) for c in zip(*map(B.unpack, blobs), strict=True))
        unit = _units_of(counts)
        by = columns[0][unit] if by_unit else columns[per_unit]
        _send(sender, kind, groups, by, unit, columns[:per_unit], columns[per_unit:])

    return run


def _send_texts(sender: B.Sender, kind: int, groups: int, ids: np.ndarray, data: list[bytes]) -> None:
    squeeze = zstandard.ZstdCompressor(level=1)
    for part, at in B.split_by(_by(K.mix(ids.astype(np.uint64)), groups), groups):
        some = [data[i] for i in at]
        sender.add(part, kind, B.pack(ids[at], np.array([len(x) for x in some], dtype=np.int64), np.frombuffer(squeeze.compress(b"".join(some)), dtype=np.uint8)))


def _texts(lengths: np.ndarray, packed: np.ndarray) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed.tobytes(), max_output_size=int(lengths.sum()) + 1)
    return [data[e - m : e] for e, m in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]


def _cut_texts(sender: B.Sender, kind: int, groups: int, blobs: list[bytes]) -> None:
    """What `_send_texts` sent to its groups, for `blobs.by_group`."""
    ids, lengths, packed = zip(*map(B.unpack, blobs), strict=True)
    _send_texts(sender, kind, groups, np.concatenate(ids), [x for some in zip(lengths, packed, strict=True) for x in _texts(*some)])


def _gather(batches, kind: int, forward: B.Sender | None = None):
    """All blobs of one kind: unit index a token, then the per-unit and per-token arrays; others are sent on."""
    stores: list[list[np.ndarray]] = []
    for batch in batches:
        for part, k, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if k == kind:
                stores.append(B.unpack(blob))
            elif forward is not None:
                forward.add(part, k, blob)
    if not stores:
        return None
    counts = np.concatenate([s[0].astype(np.int64) for s in stores])
    return _units_of(counts), *(np.concatenate([s[1 + i] for s in stores]) for i in range(len(stores[0]) - 1))


def _shared(token: np.ndarray, unit: np.ndarray):
    """Order of the distinct (token, unit) pairs by token, and each one's number of units."""
    order = np.lexsort((unit, token))
    t, u = token[order], unit[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
    order, t = order[new], t[new]
    first = np.ones(len(t), dtype=bool)
    first[1:] = t[1:] != t[:-1]
    edges = np.append(np.flatnonzero(first), len(t))
    return order, np.repeat(np.diff(edges), np.diff(edges))


def _sets(data: list[bytes], n: int):
    for s in K.shingle_sets_of(data, n):
        yield s, K.set_hash(s, 1)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """A row for each document row: key, n_shingles, component_id.

    Documents link when their sets of n-word shingles (ASCII letters lowered, words between
    ASCII white space) have at least the threshold's Jaccard similarity.  A text with fewer
    words than n has its whole word sequence as its one shingle.  A null text or one without
    words has an empty set and links with nothing; its component is itself.  Rows that repeat
    a key are documents of their own with that key.  A null key takes part as the greatest
    key; a component of such rows alone has a null id.  Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = _components(docs, key, text, n, threshold).withColumn("c", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("d")))
    clean = lambda c: F.when(F.col(c) != int(_NULL_ID), F.col(c)).cast(kind)
    return out.select(clean("d").alias(key), F.col("n").alias("n_shingles"), clean("c").alias("component_id"))


def _row_key(key: str, text: str):
    """Columns d and x that tell a row: its key, nulls as the greatest, and a hash of its text."""
    return F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL_ID))).alias("d"), F.xxhash64(text).alias("x")


def _components(docs: DataFrame, key: str, text: str, n: int, threshold: tuple[int, int]) -> DataFrame:
    """A row for each document row: d and x, n, its component and that one's least d (both null for an empty set)."""
    num, den = threshold
    groups = _groups(docs, text)
    parts = B.dealt_to(groups)
    rows = docs.select(*_row_key(key, text), F.col(text).alias("t"))

    def first_pass(batches):
        sender = B.Sender()
        for batch in batches:
            all_ids, all_marks, all_data = batch.column("d").to_numpy(), batch.column("x").to_numpy(), [x or b"" for x in texts_of(batch, "t")]
            for lo, hi in K.chunks(all_data, LOCAL_BYTES):
                sizes, units, prefixes, owners, seen = [], [], [], [], {}
                for s, h in _sets(all_data[lo:hi], n):
                    sizes.append(len(s))
                    units.append(h)
                    if len(s) and h not in seen:
                        seen[h] = len(seen)
                        m = len(s) - need(len(s), num, den) + max(1, int(np.ceil(FIRST_SHARE * len(s))))
                        prefixes.append(s[:m])
                ids, marks, sizes, units = all_ids[lo:hi], all_marks[lo:hi], np.array(sizes, dtype=np.int64), np.array(units, dtype=np.uint64)
                for part, at in B.split_by(_by(units, parts), parts):
                    sender.add(part, _INFO, B.pack(ids[at], marks[at], sizes[at], units[at]))
                if prefixes:
                    distinct = np.fromiter(seen, dtype=np.uint64, count=len(seen))
                    owners = _units_of(np.array([len(p) for p in prefixes]))
                    tokens = np.concatenate(prefixes)
                    order, df = _shared(tokens, owners)
                    known = df > 1  # shared within the task: one unit tells the others, all count it here
                    times = np.bincount(owners[order[known]], minlength=len(distinct))
                    for part, at in B.split_by(_by(distinct, parts), parts):
                        at = at[times[at] > 0]
                        if len(at):
                            sender.add(part, _HITS, B.pack(distinct[at], B.narrow(times[at])))
                    one = np.ones(len(order), dtype=bool)
                    one[1:] = tokens[order[1:]] != tokens[order[:-1]]
                    sent = np.sort(order[one])
                    shared = np.zeros(len(tokens), dtype=np.uint8)
                    shared[order[known]] = 1
                    _send(sender, _TOKENS, parts, tokens[sent], owners[sent], [distinct], [tokens[sent], shared[sent]])
                yield from sender.full()
        yield from sender.rest()

    def count_shared(batches):
        sender = B.Sender()
        got = _gather(batches, _TOKENS, sender)
        if got:
            owner, unit, token, shared = got
            order, df = _shared(token, unit[owner])
            told = np.unique(token[shared > 0])
            if len(told):
                at = np.minimum(np.searchsorted(told, token[order]), len(told) - 1)
                df = np.where(told[at] == token[order], 2, df)
            hit = order[(df > 1) & (shared[order] == 0)]
            found, times = np.unique(unit[owner[hit]], return_counts=True)
            for part, at in B.split_by(_by(found, parts), parts):
                sender.add(part, _HITS, B.pack(found[at], B.narrow(times[at])))
        yield from sender.rest()

    def survivors(batches):
        info, hits = [], []
        for batch in batches:
            for k, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                (info if k == _INFO else hits).append(B.unpack(blob))
        total = {}
        if hits:
            u, inverse = np.unique(np.concatenate([h[0] for h in hits]), return_inverse=True)
            total = dict(zip(u.tolist(), np.bincount(inverse, weights=np.concatenate([h[1].astype(np.float64) for h in hits])).astype(int).tolist(), strict=True))
        for ids, marks, sizes, units in info:
            asked = np.maximum(1, np.ceil(FIRST_SHARE * sizes)).astype(np.int64)
            times = np.array([total.get(x, 0) for x in units.tolist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(sizes), pa.array(units.view(np.int64)), pa.array((times >= asked) & (sizes > 0))], names=["d", "x", "n", "u", "alive"])

    cuts = {_INFO: B.cut_by(3), _HITS: B.cut_by(0), _TOKENS: _cut_sent(1)}
    dealt = B.by_group(rows.mapInArrow(tidy(first_pass), B.SCHEMA), groups, count_shared, B.SCHEMA, cuts)
    info = cut(B.by_group(dealt, groups, survivors, "d long, x long, n long, u long, alive boolean", cuts), "sets")
    classes = info.where("n > 0").groupBy("u").agg(F.min("d").alias("rep"), F.max("alive").alias("alive"))

    def send_alive(batches):
        sender = B.Sender()
        for batch in batches:
            d, u = batch.column("rep").to_numpy(), batch.column("u").to_numpy()
            for part, at in B.split_by(_by(K.mix(d.astype(np.uint64)), parts), parts):
                sender.add(part, _ALIVE, B.pack(d[at], u[at]))
        yield from sender.rest()

    def send_texts(batches):
        sender = B.Sender()
        for batch in batches:
            ids, data = batch.column("d").to_numpy(), [x or b"" for x in texts_of(batch, "t")]
            for lo, hi in K.chunks(data, LOCAL_BYTES):
                _send_texts(sender, _TEXTS, parts, ids[lo:hi], data[lo:hi])
                yield from sender.full()
        yield from sender.rest()

    def whole_sets(batches):
        sender = B.Sender()
        alive: dict[int, set[int]] = {}
        units: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def deal():
            if sets:
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                tokens, owner, names = np.concatenate(sets), _units_of(sizes), np.array(units, dtype=np.uint64)
                order, df = _shared(tokens, owner)
                hot = np.zeros(len(tokens), dtype=bool)
                hot[order[df > HOT_UNITS]] = True
                told = hot.copy()  # one of its units tells the others that a token is hot
                told[order[1:][tokens[order[1:]] == tokens[order[:-1]]]] = False
                by = names[owner[hot]]
                _send(sender, _HITS, parts, by, owner[hot], [names, sizes], [tokens[hot], np.full(int(hot.sum()), HOT, dtype=np.uint32)])
                sent = ~hot | told
                _send(sender, _TOKENS, parts, tokens[sent], owner[sent], [names, sizes], [tokens[sent], hot[sent].astype(np.uint8)])
            units.clear()
            sets.clear()

        for batch in batches:
            for k, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _ALIVE:
                    for d, u in zip(*(x.tolist() for x in B.unpack(blob)), strict=True):
                        alive.setdefault(d, set()).add(u)
                    continue
                ids, lengths, packed = B.unpack(blob)
                if not any(d in alive for d in ids.tolist()):
                    continue
                some = [(d, x) for d, x in zip(ids.tolist(), _texts(lengths, packed), strict=True) if d in alive]
                for (d, _), (s, h) in zip(some, _sets([x for _, x in some], n), strict=True):
                    if len(s) and int(np.uint64(h).astype(np.int64)) in alive[d]:
                        units.append(h)
                        sets.append(s)
                        held += len(s)
                if held >= DEAL_TOKENS:
                    deal()
                    held = 0
                yield from sender.full()
        deal()
        yield from sender.rest()

    def frequencies(batches):
        sender = B.Sender()
        got = _gather(batches, _TOKENS, sender)
        if got:
            owner, unit, size, token, hot = got
            order, df = _shared(token, unit[owner])
            told = np.unique(token[hot > 0])
            if len(told):
                at = np.minimum(np.searchsorted(told, token[order]), len(told) - 1)
                df = np.where(told[at] == token[order], HOT, df)
            keep = (df > 1) & (hot[order] == 0)
            order, df = order[keep], df[keep]
            by_unit = np.argsort(unit[owner[order]], kind="stable")
            order, df = order[by_unit], df[by_unit]
            ids, index, at = np.unique(unit[owner[order]], return_index=True, return_inverse=True)
            _send(sender, _HITS, parts, ids[at], at, [ids, size[owner[order[index]]]], [token[order], df.astype(np.uint32)])
        yield from sender.rest()

    def ordered_units(batches):
        got = _gather(batches, _HITS)
        if not got:
            return
        owner, unit, size, token, df = got
        units, at = np.unique(unit, return_inverse=True)
        sizes = np.zeros(len(units), dtype=np.int64)
        sizes[at] = size
        mine = at[owner]
        order = np.lexsort((token, df, mine))
        mine, token, df = mine[order], token[order], df[order].astype(np.float64)
        once = np.ones(len(mine), dtype=bool)
        once[1:] = (mine[1:] != mine[:-1]) | (token[1:] != token[:-1])
        mine, token, df = mine[once], token[once], df[once]
        edges = np.searchsorted(mine, np.arange(len(units) + 1))
        out: list[tuple] = []
        for i in range(len(units)):
            t, f, m = token[edges[i] : edges[i + 1]], df[edges[i] : edges[i + 1]], int(sizes[i])
            base = len(t) - need(m, num, den)  # shared tokens in the prefix, before l
            if base < 0:
                continue  # too few shared tokens for any link
            cost = np.cumsum(f - 1)
            choices = [1]
            while choices[-1] * 2 <= max(1, m // 8) and base + choices[-1] * 2 <= len(t):
                choices.append(choices[-1] * 2)
            best = min(choices, key=lambda c: cost[base + c - 1] * (1 + VERIFY_COST / c))
            out.append((int(units[i].astype(np.int64)), m, base, best, len(t), t.tobytes()))
            if len(out) >= 2000:
                yield unit_batch(out)
                out = []
        if out:
            yield unit_batch(out)

    def unit_batch(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["u", "n", "base", "ell", "m", "t"])

    alive = classes.where("alive").select("rep", "u").mapInArrow(tidy(send_alive), B.SCHEMA)
    met = alive.union(rows.mapInArrow(tidy(send_texts), B.SCHEMA))
    sets = B.by_group(met, groups, whole_sets, B.SCHEMA, {_ALIVE: B.cut_by(0, K.mix), _TEXTS: _cut_texts}, ordered=True)
    cuts = {_HITS: _cut_sent(2, by_unit=True), _TOKENS: _cut_sent(2)}
    counted = B.by_group(sets, groups, frequencies, B.SCHEMA, cuts)
    units = cut(B.by_group(counted, groups, ordered_units, "u long, n long, base long, ell long, m long, t binary", cuts), "units")
    links = _links(units, groups, num, den)
    comps = components(links, "u", "v").select(F.col("node").alias("u"), "component")
    reps = classes.select("u", "rep").join(comps, "u", "left").select("u", "rep", F.coalesce("component", "u").alias("component"))
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    named = reps.join(least, "component").select("u", "component", "least")
    return info.join(named, "u", "left").select("d", "x", "n", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("component", "least")))


def _links(units: DataFrame, groups: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between units that span all components."""
    parts = B.dealt_to(groups)

    def base_prefixes(batches):
        sender = B.Sender()
        for batch in batches:
            u, base, t = batch.column("u").to_numpy(), batch.column("base").to_numpy(), batch.column("t").to_pylist()
            if len(u):
                heads = [np.frombuffer(x, dtype="<u8", count=int(b) + 1) for x, b in zip(t, base, strict=True)]
                tokens = np.concatenate(heads)
                _send(sender, _TOKENS, parts, tokens, _units_of(np.array([len(h) for h in heads])), [u], [tokens])
            yield from sender.full()
        yield from sender.rest()

    def name_hubs(batches):
        got = _gather(batches, _TOKENS)
        sender = B.Sender()
        if got:
            owner, unit, token = got
            u = unit[owner]
            order = np.lexsort((u, token))
            t, u = token[order], u[order]
            new = np.ones(len(t), dtype=bool)
            new[1:] = t[1:] != t[:-1]
            hub = u[np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))]
            order = np.lexsort((hub, u))
            u, hub = u[order], hub[order]
            new = np.ones(len(u), dtype=bool)
            new[1:] = (u[1:] != u[:-1]) | (hub[1:] != hub[:-1])
            edges = np.append(np.flatnonzero(new), len(u))
            u, hub, times = u[new], hub[new], np.diff(edges)
            for part, at in B.split_by(_by(u, parts), parts):
                sender.add(part, _TOKENS, B.pack(u[at], hub[at], B.narrow(times[at]).astype(np.uint32)))
        yield from sender.rest()

    def choose_hubs(batches):
        stores = [B.unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if not stores:
            return
        u, hub, times = (np.concatenate([s[i] for s in stores]) for i in range(3))
        order = np.lexsort((hub, u))
        u, hub, times = u[order], hub[order], times[order].astype(np.int64)
        new = np.ones(len(u), dtype=bool)
        new[1:] = (u[1:] != u[:-1]) | (hub[1:] != hub[:-1])
        times = np.add.reduceat(times, np.flatnonzero(new))
        u, hub = u[new], hub[new]
        order = np.lexsort((hub, -times, u))
        u, hub = u[order], hub[order]
        first = np.ones(len(u), dtype=bool)
        first[1:] = u[1:] != u[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(hub[first])], names=["u", "hub"])

    named = B.by_group(units.select("u", "base", "t").mapInArrow(tidy(base_prefixes), B.SCHEMA), groups, name_hubs, B.SCHEMA, {_TOKENS: _cut_sent(1)})
    hubs = B.by_group(named, groups, choose_hubs, "u long, hub long", {_TOKENS: B.cut_by(0)})
    hubbed = cut(units.join(hubs, "u"), "hubs")

    def long_prefixes(batches):
        sender = B.Sender()
        for batch in batches:
            u, hub, m, base, ell = (batch.column(c).to_numpy() for c in ("u", "hub", "n", "base", "ell"))
            t = batch.column("t").to_pylist()
            if len(u):
                heads = [np.frombuffer(x, dtype="<u8", count=int(b)) for x, b in zip(t, base + ell, strict=True)]
                sizes = np.array([len(h) for h in heads])
                owner = _units_of(sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                level = np.maximum(1, place + 1 - base[owner])  # the least l whose prefix holds the token
                tokens = np.concatenate(heads)
                _send(sender, _TOKENS, parts, tokens, owner, [u, hub, m, ell], [tokens, level.astype(np.uint32)])
            yield from sender.full()
        yield from sender.rest()

    def hub_pairs(batches):
        """Hubs that meet in a token, with the pairs of units that they would give; a list of many pairs chains its hubs."""
        got = _gather(batches, _TOKENS)
        if not got:
            return
        owner, _, hub, _, _, token, _ = got
        of = hub[owner]
        order = np.lexsort((of, token))
        token, of = token[order], of[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        times, token, of = np.diff(np.append(at, len(of))).astype(np.int64), token[at], of[at]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(begin, len(token)))
        every, squares = np.add.reduceat(times, begin), np.add.reduceat(times * times, begin)
        crowded = np.repeat((every * every - squares) // 2 >= MERGE_POSTINGS, count)
        rest = np.repeat(begin + count, count) - np.arange(len(token)) - 1  # hubs that follow in the list
        found = []
        for s in range(1, int(count.max())):
            able = np.flatnonzero((rest >= s) & (~crowded | (s == 1)))
            if not len(able):
                break
            found.append((of[able], of[able + s], np.where(crowded[able], MERGE_POSTINGS, times[able] * times[able + s])))
            if sum(len(f[0]) for f in found) > 2_000_000:
                found = [total(found)]
        if found:
            x, y, w = total(found)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(w)], names=["x", "y", "w"])

    def total(found):
        x, y, w = (np.concatenate([f[i] for f in found]) for i in range(3))
        o = np.lexsort((y, x))
        x, y, w = x[o], y[o], w[o]
        first = np.ones(len(x), dtype=bool)
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        at = np.flatnonzero(first)
        return x[at], y[at], np.add.reduceat(w, at) if len(at) else w

    prefixes = {_TOKENS: _cut_sent(4)}
    postings = B.by_group(hubbed.mapInArrow(tidy(long_prefixes), B.SCHEMA), groups, hub_pairs, "x long, y long, w long", prefixes)
    close = postings.groupBy("x", "y").agg(F.sum("w").alias("w")).where(F.col("w") >= MERGE_POSTINGS)
    merged = components(close, "x", "y").select(F.col("node").alias("hub"), "component")
    hubbed = cut(hubbed.join(merged, "hub", "left").withColumn("hub", F.coalesce("component", "hub")).drop("component"), "merged-hubs")

    inside = _inside(hubbed, parts, num, den)

    def cross_pairs(batches):
        got = _gather(batches, _TOKENS)
        sender = B.Sender()
        if got:
            owner, unit, hub, size, ell, token, level = got
            order = np.argsort(token, kind="stable")
            owner, token, level = owner[order], token[order], level[order].astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])).tolist()
            held: list[tuple[np.ndarray, ...]] = []
            pending = 0

            def flush():
                if held:
                    x, y, asked = (np.concatenate([h[i] for h in held]) for i in range(3))
                    o = np.lexsort((y, x))
                    x, y, asked = x[o], y[o], asked[o]
                    new = np.ones(len(x), dtype=bool)
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    times = np.diff(np.append(np.flatnonzero(new), len(x)))
                    x, y, asked = x[new], y[new], asked[new]
                    for part, at in B.split_by(_by(K.mix(x.view(np.uint64)), parts), parts):
                        sender.add(part, _TOKENS, B.pack(x[at], y[at], B.narrow(asked[at]).astype(np.uint32), B.narrow(times[at]).astype(np.uint32)))
                    held.clear()

            for a, b in zip(edges, edges[1:], strict=False):
                who = owner[a:b]
                if b - a < 2 or (hub[who] == hub[who[0]]).all():
                    continue
                lev = level[a:b]
                for i in range(0, b - a, 512):  # a slice of the list against what follows it
                    p, q = np.nonzero(hub[who[i : i + 512]][:, None] != hub[who[i:]][None, :])
                    later = q > p
                    p, q = p[later] + i, q[later] + i
                    x, y = who[p], who[q]
                    asked = np.minimum(ell[x], ell[y])
                    ok = (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y])) & (np.maximum(lev[p], lev[q]) <= asked)
                    x, y, asked = unit[x[ok]], unit[y[ok]], asked[ok]
                    held.append((np.minimum(x, y), np.maximum(x, y), asked))
                    pending += len(x)
                    if pending > 2_000_000:
                        flush()
                        pending = 0
                        yield from sender.full()
            flush()
        yield from sender.rest()

    def candidates(batches):
        stores = [B.unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if not stores:
            return
        x, y, asked, times = (np.concatenate([s[i] for s in stores]) for i in range(4))
        order = np.lexsort((y, x))
        x, y, asked, times = x[order], y[order], asked[order], times[order].astype(np.int64)
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        at = np.flatnonzero(new)
        ok = np.add.reduceat(times, at) >= asked[at]
        yield pa.RecordBatch.from_arrays([pa.array(x[at][ok]), pa.array(y[at][ok])], names=["u", "v"])

    def verify(batches):
        for batch in batches:
            keep = []
            for na, nb, a, b in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True):
                both = np.intersect1d(np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8"), assume_unique=True)
                keep.append(linked(len(both), na, nb, num, den))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    crossing = B.by_group(hubbed.mapInArrow(tidy(long_prefixes), B.SCHEMA), groups, cross_pairs, B.SCHEMA, prefixes)
    pairs = B.by_group(crossing, groups, candidates, "u long, v long", {_TOKENS: B.cut_by(0, K.mix)})
    left = units.select("u", F.col("n").alias("na"), F.col("t").alias("ta"))
    right = units.select(F.col("u").alias("v"), F.col("n").alias("nb"), F.col("t").alias("tb"))
    across = pairs.join(left, "u").join(right, "v").select("u", "v", "na", "nb", "ta", "tb").mapInArrow(tidy(verify), "u long, v long")
    return inside.union(across)


class _Block:
    """Units of one hub with posting lists of their prefixes; finds links between units of different labels."""

    def __init__(self, members: list[tuple], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.units = [m[0] for m in members]
        self.size, self.base, self.ell = (np.array([m[k] for m in members], dtype=np.int64) for k in (1, 2, 3))
        self.sets = [np.frombuffer(m[4], dtype="<u8") for m in members]
        self.label = np.array([m[5] for m in members], dtype=np.int64) if members and len(members[0]) > 5 else np.arange(len(members))
        heads = [s[: b + e] for s, b, e in zip(self.sets, self.base.tolist(), self.ell.tolist(), strict=True)]
        n = np.array([len(h) for h in heads], dtype=np.int64)
        owner = _units_of(n)
        level = np.maximum(1, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + 1 - self.base[owner])
        token = np.concatenate(heads) if heads else np.empty(0, dtype=np.uint64)
        order = np.argsort(token, kind="stable")
        self.owner, self.level = owner[order], level[order]
        self.token, first = np.unique(token[order], return_index=True)
        self.edges = np.append(first, len(token))

    def partners(self, size: int, base: int, ell: int, tokens: np.ndarray, label: int):
        """Members of another label that link with a unit, a few at a time; labels may change in between."""
        head = tokens[: base + ell]
        at = np.minimum(np.searchsorted(self.token, head), max(0, len(self.token) - 1))
        known = np.flatnonzero(self.token[at] == head) if len(self.token) else np.empty(0, dtype=int)
        begin, count = self.edges[at[known]], self.edges[at[known] + 1] - self.edges[at[known]]
        place = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        who = self.owner[place]
        asked = np.minimum(ell, self.ell)
        level = np.maximum(np.repeat(np.maximum(1, known + 1 - base), count), self.level[place])
        shared = np.bincount(who[level <= asked[who]], minlength=len(self.units))
        able = (shared >= asked) & (self.den * np.minimum(size, self.size) >= self.num * np.maximum(size, self.size)) & (self.label != label)
        candidates = np.flatnonzero(able)
        own = np.sort(tokens)
        for lo in range(0, len(candidates), 1024):
            some = candidates[lo : lo + 1024]
            some = some[self.label[some] != label]
            if not len(some):
                continue
            n = np.array([len(self.sets[i]) for i in some.tolist()])
            every = np.concatenate([self.sets[i] for i in some.tolist()])
            both = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            overlap = np.add.reduceat(both.astype(np.int64), np.cumsum(n) - n)
            yield some[linked(overlap, size, self.size[some], self.num, self.den)].tolist()

    def link(self, x: int) -> list[tuple[int, int]]:
        """Links from a member to one unit of each other component that it reaches."""
        out = []
        for some in self.partners(int(self.size[x]), int(self.base[x]), int(self.ell[x]), self.sets[x], int(self.label[x])):
            for y in some:
                if self.label[y] != self.label[x]:
                    out.append((self.units[x], self.units[y]))
                    self.label[self.label == self.label[y]] = self.label[x]
        return out

    def forest(self) -> list[tuple[int, int]]:
        """Links that span the members' components.

        Members are taken until all that are left lie in one component: links among those would join nothing.
        """
        left, out = np.ones(len(self.units), dtype=bool), []
        while True:
            rest = np.flatnonzero(left)
            if not len(rest):
                return out
            found, sizes = np.unique(self.label[rest], return_counts=True)
            if len(found) == 1:
                return out
            x = int(rest[np.argmax(self.label[rest] != found[np.argmax(sizes)])])
            left[x] = False
            out += self.link(x)

    def main(self) -> np.ndarray:
        """Members of the largest component."""
        found, sizes = np.unique(self.label, return_counts=True)
        return np.flatnonzero(self.label == found[np.argmax(sizes)])


def _inside(hubbed: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Links (u, v) that span the components of each hub's units, whose blocks stream through `parts` partitions."""
    fields = ["u", "n", "base", "ell", "t"]
    sizes = hubbed.groupBy("hub").agg(F.sum("m").alias("tokens"), F.count("*").alias("rows")).where("rows > 1")
    sizes = sizes.select("hub", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"))
    own = (F.xxhash64("u").bitwiseAND(F.lit(0x7FFFFFFF)) % F.col("blocks")).cast("int")
    blocked = hubbed.join(sizes, "hub").withColumn("own", own).select("hub", "blocks", "own", *fields)

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hub", "u", "v"])

    def join_blocks(batches):
        """A block's links, and (hub, unit, null) of the units that connect it with the hub's other blocks."""
        name, members, pieces = None, [], 1
        out: list[tuple] = []

        def close():
            if len(members) > 1 or pieces > 1:
                block = _Block(members, num, den)
                out.extend((name[0], u, v) for u, v in block.forest())
                if pieces > 1:
                    out.extend((name[0], block.units[i], None) for i in block.main()[:PIVOTS].tolist())

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hub", "own", "blocks", *fields)]
            for hub, own_, blocks, *member in zip(*columns, strict=True):
                if (hub, own_) != name:
                    if name:
                        close()
                    name, members, pieces = (hub, own_), [], blocks
                members.append(tuple(member))
            if out:
                yield batch_of(out)
                out.clear()
        if name:
            close()
        yield batch_of(out)

    def connect(batches):
        """Links between the units that stand for a hub's blocks."""
        name, members = None, []
        out: list[tuple] = []
        for batch in batches:
            for hub, *member in zip(*(batch.column(c).to_pylist() for c in ("hub", *fields)), strict=True):
                if hub != name:
                    if members:
                        out += [(name, *x) for x in _Block(members, num, den).forest()]
                    name, members = hub, []
                members.append(tuple(member))
        if members:
            out += [(name, *x) for x in _Block(members, num, den).forest()]
        yield batch_of(out)

    def meet_rest(batches):
        """Links of the units outside a hub's largest component with the units of each block, which come first."""
        name, members, block = None, [], None
        out: list[tuple] = []
        for batch in batches:
            for hub, own_, outside, *member in zip(*(batch.column(c).to_pylist() for c in ("hub", "own", "outside", *fields, "label")), strict=True):
                if (hub, own_) != name:
                    name, members, block = (hub, own_), [], None
                if not outside:
                    members.append(tuple(member))
                    continue
                if block is None:
                    block = _Block(members, num, den)
                u, size, base, ell, t, label = member
                seen = set()
                for some in block.partners(size, base, ell, np.frombuffer(t, dtype="<u8"), label):
                    for y in some:
                        if int(block.label[y]) not in seen:
                            seen.add(int(block.label[y]))
                            out.append((hub, u, block.units[y]))
            if out:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    schema = "hub long, u long, v long"
    found = cut(blocked.repartition(parts, "hub", "own").sortWithinPartitions("hub", "own").mapInArrow(tidy(join_blocks), schema), "blocks")
    links = found.where("v is not null")
    pivots = found.where("v is null").select("hub", "u")
    if not pivots.limit(1).count():
        return links.select("u", "v")
    wide = blocked.where("blocks > 1")
    links = links.union(cut(pivots.join(wide, ["hub", "u"]).repartition(parts, "hub").sortWithinPartitions("hub").mapInArrow(tidy(connect), schema), "pivots"))
    comps = components(links.join(sizes.where("blocks > 1").select("hub"), "hub"), "u", "v").select(F.col("node").alias("u"), F.col("component").alias("label"))
    wide = cut(wide.join(comps, "u", "left").withColumn("label", F.coalesce("label", "u")), "labelled")
    counted = wide.groupBy("hub", "label").agg(F.count("*").alias("units"))
    main = counted.groupBy("hub").agg(F.max_by("label", F.struct("units", "label")).alias("main"))
    outside = wide.join(main, "hub").where("label <> main").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["hub", "own", "outside", *fields, "label"]
    met = wide.withColumn("outside", F.lit(False)).select(*names).union(outside.withColumn("outside", F.lit(True)).select(*names))
    rest = met.repartition(parts, "hub", "own").sortWithinPartitions("hub", "own", "outside").mapInArrow(tidy(meet_rest), schema)
    return links.union(rest).select("u", "v")


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """One row of `docs` for each component: the one of the least key (nulls last), of several texts under it one.

    Documents with an empty set all stay.  Rows that repeat key and text are copies of each other: one of them stays.
    """
    found = cut(_components(docs, key, text, n, threshold).where("component is not null"), "members")
    first = found.groupBy("component").agg(F.min(F.struct("d", "x")).alias("first"))
    gone = found.join(first, "component").where((F.col("d") != F.col("first.d")) | (F.col("x") != F.col("first.x"))).select("d", "x").distinct()
    names = [fresh(docs, "row_d"), fresh(docs, "row_x")]
    marked = docs.select("*", *(c.alias(m) for c, m in zip(_row_key(key, text), names, strict=True)))
    same = lambda other: (marked[names[0]] == other["d"]) & (marked[names[1]] == other["x"])
    kept = marked.join(gone, same(gone), "left_anti")
    again = found.groupBy("d", "x").agg(F.count("*").alias("rows")).where("rows > 1").select("d", "x")
    if not again.limit(1).count():
        return kept.drop(*names)
    place = fresh(docs, "row_place")
    copies = kept.join(again, (kept[names[0]] == again["d"]) & (kept[names[1]] == again["x"]), "left_semi")
    one = copies.withColumn(place, F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))).where(F.col(place) == 1).drop(place)
    return kept.join(again, (kept[names[0]] == again["d"]) & (kept[names[1]] == again["x"]), "left_anti").unionByName(one).drop(*names)
