"""Substring dedup: repeats of `window` or more consecutive words, found as deep suffix-tree nodes.

A suffix is a document's words from one position on.  Suffixes are split into groups by
variable-length prefixes: a counting pass over the whole corpus fills a trie whose edges are
words (hashed to a sixteenth each), a node that holds more than a group's share is split by its
next words until it fits, and small nodes are put together.  The prefix that decides a suffix's
group so has as many words as its neighbourhood is crowded.

A group is the part of the suffix tree below its prefixes.  It is needed from depth `window` on
only: two suffixes meet in an internal node of that depth or deeper if and only if their first
`window` words agree, and what lies below does not change which occurrence is first.  So labels are
cut there: a suffix's label is a 72-bit hash of its first `window` words, sorted labels give the
intervals of common prefixes that are deep enough, and an interval's leaves but the first in the
order of document and position are repeats.  Runs of repeated positions are the maximal
repeats; the words that they cover go.  Labels are compared within a group only, so equal ones
agree in the group's prefix too.

Scale: a map task sends one leaf a node, its first, and settles its other leaves itself, so a
passage that a third of all documents hold is a row a task, in the counts too.  At most
`MAX_PARTS` groups are dealt at once; beyond, each is dealt again by its labels, so that what a task
holds (`GROUP_SUFFIXES`) does not grow with the corpus and blocks do not shrink.  The trie's counts
are all that reaches the driver.  Suffixes travel as arrays of labels and position gaps; documents meet
their repeats in one more shuffle, as compressed blocks, with the repeats first.  A text is
taken in slices, whatever its length.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs as B
from . import tokens as K
from .common import shuffle_partitions, texts_of, tidy

#: Suffixes that a group holds at most (but for one node of full depth), and below which none is split.
GROUP_SUFFIXES, SMALL_GROUP = 2_000_000, 20_000
#: Groups that are dealt at once.
MAX_PARTS = 4096
#: Words that a map task settles by itself at a time.
LOCAL_WORDS = 2_000_000
_NULL_ID = np.iinfo(np.int64).max
_REPEATS, _SUFFIXES, _TEXTS, _COUNTS = range(4)


class Prefixes:
    """Trie of word prefixes; an edge is a pair of words, hashed to one of 256."""

    def __init__(self, window: int) -> None:
        self.levels = -(-window // 2)
        self.window = window
        self.child = np.full(1, -1, dtype=np.int64)  # first child, or -1
        self.level = np.zeros(1, dtype=np.int64)
        self.count = np.zeros(1, dtype=np.int64)
        self.part = np.zeros(1, dtype=np.int32)

    def split(self, nodes: np.ndarray) -> None:
        self.child[nodes] = len(self.child) + 256 * np.arange(len(nodes))
        self.child = np.append(self.child, np.full(256 * len(nodes), -1))
        self.level = np.append(self.level, np.repeat(self.level[nodes] + 1, 256))
        self.count = np.append(self.count, np.zeros(256 * len(nodes), dtype=np.int64))

    def find(self, nibble: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The node of the suffixes that start at places of a word array."""
        node = np.zeros(len(at), dtype=np.int64)
        for k in range(int(self.level.max())):
            first = self.child[node]
            inner = first >= 0
            last = 2 * k + 1 == self.window  # an odd window ends on half an edge
            pair = nibble[at + 2 * k] << np.uint8(4) | (np.uint8(0) if last else nibble[at + 2 * k + 1])
            node = np.where(inner, first + pair, node)
        return node

    def settle(self, limit: int) -> np.ndarray:
        """Undo splits of nodes that fit as they are; the leaves that do not fit and can be split."""
        for n in range(len(self.child) - 1, -1, -1):
            c = int(self.child[n])
            if c >= 0:
                self.count[n] = self.count[c : c + 256].sum()
                if self.count[n] <= limit:
                    self.child[n] = -1
        return np.flatnonzero(self._leaves() & (self.count > limit) & (self.level < self.levels))

    def _leaves(self) -> np.ndarray:
        """Nodes without children that can be reached."""
        reached = np.zeros(len(self.child), dtype=bool)
        reached[0] = True
        for n in np.flatnonzero(self.child >= 0).tolist():  # parents come before their children
            reached[self.child[n] : self.child[n] + 256] = reached[n]
        return reached & (self.child < 0)

    def assign(self, parts: int) -> None:
        """Leaves to parts: the largest first, each to the part that holds least."""
        self.part = np.zeros(len(self.child), dtype=np.int32)
        leaves = np.flatnonzero(self._leaves())
        held = [(0, p) for p in range(parts)]
        for n in leaves[np.argsort(-self.count[leaves], kind="stable")].tolist():
            total, p = heapq.heappop(held)
            self.part[n] = p
            heapq.heappush(held, (total + int(self.count[n]), p))


def _part_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of consecutive values."""
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])] + 1


def _send_repeats(sender: B.Sender, ids: np.ndarray, crcs: np.ndarray, doc: np.ndarray, pos: np.ndarray, groups: int) -> None:
    """Repeated positions, as runs, to the groups of their documents; `doc` indexes ids and is sorted, pos within it."""
    if not len(doc):
        return
    line = doc.astype(np.int64) * (1 << 34) + pos
    start, end = _runs(line)
    d, a, n = start >> 34, start & ((1 << 34) - 1), end - start
    for part, at in B.split_by(_part_of(ids[d], groups), groups):
        sender.add(part, _REPEATS, B.pack(ids[d[at]], crcs[d[at]], B.narrow(a[at]), B.narrow(n[at])))


def _send_texts(sender: B.Sender, groups: int, ids: np.ndarray, missing: np.ndarray, data: list[bytes]) -> None:
    squeeze = zstandard.ZstdCompressor(level=1)
    for part, at in B.split_by(_part_of(ids, groups), groups):
        some = [data[i] for i in at]
        sender.add(part, _TEXTS, B.pack(ids[at], missing[at].astype(np.uint8), np.array([len(x) for x in some], dtype=np.int64), np.frombuffer(squeeze.compress(b"".join(some)), dtype=np.uint8)))


def _read_texts(lengths: np.ndarray, packed: np.ndarray) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed.tobytes(), max_output_size=int(lengths.sum()) + 1)
    return [data[e - n : e] for e, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]


def _cut_texts(sender: B.Sender, kind: int, groups: int, blobs: list[bytes]) -> None:
    """What `_send_texts` sent to its groups, for `blobs.by_group`."""
    ids, missing, lengths, packed = zip(*map(B.unpack, blobs), strict=True)
    _send_texts(sender, groups, np.concatenate(ids), np.concatenate(missing), [x for some in zip(lengths, packed, strict=True) for x in _read_texts(*some)])


def _send_suffixes(sender: B.Sender, part: np.ndarray, parts: int, ids: np.ndarray, crcs: np.ndarray, doc: np.ndarray, pos: np.ndarray, label: np.ndarray, more: np.ndarray) -> None:
    """Suffixes to parts; `doc` indexes ids and is sorted, pos within it."""
    for p, at in B.split_by(part, parts):
        d, x = doc[at], pos[at]
        begin = np.flatnonzero(np.diff(d, prepend=-1))
        gap = np.diff(x, prepend=0)
        gap[begin] = x[begin]
        counts = np.diff(np.append(begin, len(d)))
        sender.add(p, _SUFFIXES, B.pack(ids[d[begin]], crcs[d[begin]], B.narrow(counts), B.narrow(gap), label[at], more[at]))


def _read_suffixes(blobs: list[list[np.ndarray]]):
    """(ids, crcs, document index, position, label, more) of some blobs; a document's index counts its runs."""
    n = np.concatenate([x[2].astype(np.int64) for x in blobs])
    gap = np.concatenate([x[3].astype(np.int64) for x in blobs])
    first = np.cumsum(n) - n
    pos = np.cumsum(gap)
    pos -= np.repeat(pos[first] - gap[first], n)
    ids, crcs, label, more = (np.concatenate([x[i] for x in blobs]) for i in (0, 1, 4, 5))
    return ids, crcs, np.repeat(np.arange(len(n)), n), pos, label, more


def _sorted(label: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by label (stable), and which of them equal the one before."""
    order = np.argsort(label, kind="stable")
    equal = np.zeros(len(order), dtype=bool)
    equal[1:] = label[order[1:]] == label[order[:-1]]
    if (more[order[1:]] != more[order[:-1]])[equal[1:]].any():
        order = np.lexsort((more, label))
        equal[1:] = (label[order[1:]] == label[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    return order, equal


class Suffixes:
    """The suffixes of some texts that have `window` words or more: label, words, document and position."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int) -> None:
        labels, mores, docs, places, starts, nibbles = [], [], [], [], [], []
        before = 0
        for h, doc, place in blocks:
            nibbles.append((h >> np.uint64(60)).astype(np.uint8))
            if len(h) >= window:
                at = np.flatnonzero(doc[window - 1 :] == doc[: len(h) - window + 1])
                sums = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(h * np.uint64(0xA24BAED4963EE407), out=sums[1:])
                labels.append(K.gram_hashes(h, window)[at])
                mores.append(((sums[at + window] - sums[at]) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(56)).astype(np.uint8))
                docs.append(doc[at])
                places.append(place[at])
                starts.append(at + before)
            before += len(h)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, dtype=kind)
        self.label, self.more = cat(labels, np.uint64), cat(mores, np.uint8)
        self.doc, self.pos, self.start = cat(docs, np.int64), cat(places, np.int64), cat(starts, np.int64)
        self.nibble = cat(nibbles, np.uint8)


def _texts(data: list[bytes], window: int):
    """Lists of (word hashes, document of each, position of each) blocks, of about `LOCAL_WORDS` words a list."""
    held, size = [], 0
    for lo, hi in K.chunks(data):
        if len(data[lo]) > K.CHUNK_BYTES:
            carry, done = np.empty(0, dtype=np.uint64), 0
            for part in K.slices(data[lo], K.SPACE):
                h = np.concatenate([carry, K.words_of([part], K.SPACE).hash])
                held.append((h, np.full(len(h), lo), done + np.arange(len(h))))
                carry = h[max(0, len(h) - window + 1) :]
                done += len(h) - len(carry)
                size += len(h)
                if size >= LOCAL_WORDS:
                    yield held
                    held, size = [], 0
        else:
            w = K.words_of(data[lo:hi], K.SPACE)
            n = np.diff(w.first)
            doc = np.repeat(np.arange(lo, hi), n)
            held.append((w.hash, doc, np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)))
            size += len(doc)
        if size >= LOCAL_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _leaves(batch: pa.RecordBatch, window: int):
    """(ids, crcs, suffixes, one of each node, the others, each one's first) of a batch's texts, a part at a time."""
    ids, data = batch.column("d").to_numpy(), [x or b"" for x in texts_of(batch, "t")]
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], [data[i] for i in order]
    crcs = np.array([zlib.crc32(x) for x in data], dtype=np.uint32)
    for blocks in _texts(data, window):
        s = Suffixes(blocks, window)
        by_label, again = _sorted(s.label, s.more)  # equal labels stay in order of document and position
        lead = by_label[np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))] if len(again) else by_label
        yield ids, crcs, s, np.sort(by_label[~again]), by_label[again], lead[again]


def _prefixes(rows: DataFrame, window: int, partitions: int) -> tuple[Prefixes, int, int]:
    """The trie with a part for each leaf, the number of parts, and of groups that each is dealt to again."""
    trie = Prefixes(window)
    trie.split(np.array([0]))
    if trie.levels > 1:
        trie.split(np.arange(1, 257))
    counted = 0
    while True:
        fresh, size = counted, len(trie.child)

        def count(batches, trie=trie, fresh=fresh, size=size):
            total = np.zeros(size, dtype=np.int64)
            for batch in batches:
                for _, _, s, once, _, _ in _leaves(batch, window):
                    total += np.bincount(trie.find(s.nibble, s.start[once]), minlength=size)
            nodes = np.flatnonzero(total[fresh:]) + fresh
            sender = B.Sender()
            for part, at in B.split_by(nodes // 4096, size // 4096 + 1):
                sender.add(part, _COUNTS, B.pack(B.narrow(nodes[at]), B.narrow(total[nodes[at]])))
            yield from sender.rest()

        def total(batches):
            found: dict[int, int] = {}
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    for n, c in zip(*(x.tolist() for x in B.unpack(blob)), strict=True):
                        found[n] = found.get(n, 0) + c
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found.items(), strict=True)], names=["node", "n"])

        got = rows.mapInArrow(tidy(count), B.SCHEMA).repartitionById(size // 4096 + 1, F.col("part")).mapInArrow(tidy(total), "node long, n long").toArrow()
        trie.count[got["node"].to_numpy()] = got["n"].to_numpy()
        every = int(trie.count[trie._leaves()].sum())
        groups = max(1, partitions, -(-every // GROUP_SUFFIXES))
        parts = min(groups, max(partitions, MAX_PARTS))
        counted = size
        crowded = trie.settle(max(SMALL_GROUP, -(-every // parts)))
        if not len(crowded):
            trie.assign(parts)
            return trie, parts, -(-groups // parts)
        trie.split(crowded)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, kept_text: bool = False) -> DataFrame:
    """A row for each document: key, n_words, n_removed, kept_sha256 and, on request, kept_text.

    A null text has no words; a text of fewer words than `window` loses none.  Occurrences are
    ordered by key and position, null keys last.  Rows that repeat key and text are one document
    given several times and lose the same words; rows that repeat the key with another text are
    compared by position alone.  Other columns are left out; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL_ID))).alias("d"), F.col(text).alias("t"))
    trie, parts, again = _prefixes(rows, window, shuffle_partitions(docs.sparkSession))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = B.whole_groups(max(shuffle_partitions(docs.sparkSession), size // (16 << 20) + 1))
    text_parts = B.dealt_to(groups)

    def suffixes(batches):
        sender = B.Sender()
        for batch in batches:
            for ids, crcs, s, once, same, first in _leaves(batch, window):
                real = (ids[s.doc[same]] != ids[s.doc[first]]) | (s.pos[same] != s.pos[first])  # a row given twice is no repeat of itself
                same = np.sort(same[real])
                _send_repeats(sender, ids, crcs, s.doc[same], s.pos[same], text_parts)
                _send_suffixes(sender, trie.part[trie.find(s.nibble, s.start[once])], parts, ids, crcs, s.doc[once], s.pos[once], s.label[once], s.more[once])
                yield from sender.full()
        yield from sender.rest()

    def deal_again(batches):
        """The suffixes of a part to `again` groups by their labels."""
        sender = B.Sender()
        held: list[list[np.ndarray]] = []
        owner = size_ = 0

        def deal():
            ids, crcs, run, pos, label, more = _read_suffixes(held)
            _send_suffixes(sender, owner * again + ((label >> np.uint64(20)) % np.uint64(again)).astype(np.int64), parts * again, ids, crcs, run, pos, label, more)

        for batch in batches:
            for part, k, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _REPEATS:
                    sender.add(part, k, blob)
                    continue
                if held and (part != owner or size_ >= LOCAL_WORDS):
                    deal()
                    held, size_ = [], 0
                owner = part
                held.append(B.unpack(blob))
                size_ += len(held[-1][4])
            yield from sender.full()
        if held:
            deal()
        yield from sender.rest()

    def subtrees(batches):
        sender = B.Sender()
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for part, k, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _REPEATS:
                    sender.add(part, k, blob)
                else:
                    held.append(B.unpack(blob))
            yield from sender.full()
        if held:
            ids, crcs, run, pos, label, more = _read_suffixes(held)
            held.clear()
            order, equal = _sorted(label, more)
            inner = equal.copy()  # leaves of deep nodes: intervals of two labels or more
            inner[:-1] |= equal[1:]
            at = order[inner]
            node = np.cumsum(~equal[inner])
            run, pos = run[at], pos[at]
            del order, equal, label, more, at
            order = np.lexsort((pos, ids[run], node))
            node, run, pos = node[order], run[order], pos[order]
            d = ids[run]
            new = np.ones(len(node), dtype=bool)
            new[1:] = node[1:] != node[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
            again_ = (d != d[lead]) | (pos != pos[lead])
            run, pos = run[again_], pos[again_]
            order = np.lexsort((pos, run))
            _send_repeats(sender, ids, crcs, run[order], pos[order], text_parts)
        yield from sender.rest()

    def texts(batches):
        sender = B.Sender()
        for batch in batches:
            ids, data = batch.column("d").to_numpy(), texts_of(batch, "t")
            missing = np.array([x is None for x in data], dtype=bool)
            for lo, hi in K.chunks([x or b"" for x in data], 8 << 20):
                _send_texts(sender, text_parts, ids[lo:hi], missing[lo:hi], [x or b"" for x in data[lo:hi]])
                yield from sender.full()
        yield from sender.rest()

    def settle(batches):
        found: list[list[np.ndarray]] = []
        lookup = None
        for batch in batches:
            for k, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _REPEATS:
                    found.append(B.unpack(blob))
                    continue
                if lookup is None:
                    lookup = _Repeats(found, window)
                ids, missing, lengths, packed = B.unpack(blob)
                some = _read_texts(lengths, packed)
                for lo, hi in K.chunks(some):
                    yield result(lookup.apply(ids[lo:hi], missing[lo:hi], some[lo:hi], kept_text))

    def result(out):
        columns = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        width = 5 if kept_text else 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:width], types, strict=False)], names=["d", "n_words", "n_removed", "kept_sha256", "kept_text"][:width])

    dealt = rows.mapInArrow(tidy(suffixes), B.SCHEMA)
    dealt = dealt.repartitionById(parts, F.pmod(F.col("part"), F.lit(parts)))
    if again > 1:  # a part's groups stay in its partition and come one after the other
        repeats = dealt.mapInArrow(tidy(deal_again), B.SCHEMA).sortWithinPartitions("part").mapInArrow(tidy(B.each(subtrees)), B.SCHEMA)
    else:
        repeats = dealt.mapInArrow(tidy(subtrees), B.SCHEMA)
    both = repeats.union(rows.mapInArrow(tidy(texts), B.SCHEMA))
    schema = "d long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if kept_text else "")
    found = B.by_group(both, groups, settle, schema, {_REPEATS: B.cut_by(0, K.mix), _TEXTS: _cut_texts}, ordered=True)
    return found.select(F.when(F.col("d") != int(_NULL_ID), F.col("d")).cast(kind).alias(key), *found.columns[1:])


class _Repeats:
    """Runs of repeated positions of a group's documents."""

    def __init__(self, parts: list[list[np.ndarray]], window: int) -> None:
        self.window = window
        cat = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.empty(0, dtype=np.int64) for i in range(4)]
        order = np.lexsort((cat[1], cat[0]))
        self.ids, self.crcs, self.start, self.count = (x[order] for x in cat)

    def kept(self, doc: int, crc: int, words: int) -> np.ndarray | None:
        """Which words of a document no repeated window covers; None for all."""
        lo, hi = np.searchsorted(self.ids, doc, side="left"), np.searchsorted(self.ids, doc, side="right")
        a, b = lo + np.searchsorted(self.crcs[lo:hi], crc, side="left"), lo + np.searchsorted(self.crcs[lo:hi], crc, side="right")
        if a == b:
            return None
        change = np.zeros(words + 1, dtype=np.int32)
        np.add.at(change, self.start[a:b], 1)
        np.add.at(change, self.start[a:b] + self.count[a:b] - 1 + self.window, -1)
        return np.cumsum(change, dtype=np.int32)[:words] == 0

    def apply(self, ids: np.ndarray, missing: np.ndarray, data: list[bytes], kept_text: bool) -> list[tuple]:
        w = K.words_of(data, K.SPACE, hashed=False)
        out = []
        for k, (doc, null, x) in enumerate(zip(ids.tolist(), missing.tolist(), data, strict=True)):
            start, end = w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]]
            n = len(start)
            keep = self.kept(doc, zlib.crc32(x), n)
            if keep is not None:
                start, end = start[keep], end[keep]
            kept = _joined(w.raw, start, end)
            out.append((doc, n, n - len(start), hashlib.sha256(kept).hexdigest(), None if null or not kept_text else kept.decode("utf-8", "replace")))
        return out


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words of a byte array with one space between."""
    if not len(start):
        return b""
    base, stop = int(start[0]), int(end[-1])
    own = raw[base : stop + 1].copy()
    own[end - base] = 32
    step = np.zeros(len(own) + 1, dtype=np.int8)
    step[start - base] += 1
    step[end + 1 - base] -= 1  # a word's end may be the next one's start
    return own[np.cumsum(step[:-1], dtype=np.int8).view(bool)].tobytes()[:-1]
