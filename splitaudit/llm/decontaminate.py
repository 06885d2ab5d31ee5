"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words go into one suffix automaton a block; document words are streamed through
it while the longest match that ends at each word is tracked.  A word is hit if an
occurrence of an item window covers it.  Windows are `window` consecutive item words; an
item with fewer words, but some, is one window.

Scale: the benchmark is a stated query set.  It is read in blocks of at most `block_words`
words (or one item); only one block is broadcast at a time, and the documents take one
map-only pass for each block.  Documents are never shuffled.  Before the automaton a
bitmap of the block's word pairs leaves the runs of words that could hold a window: it has
false positives, which the automaton rejects, and no false negatives.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as K
from .common import cut, fresh, new_column, texts_of, tidy

#: Words of benchmark text in one broadcast block.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the windows that each state holds."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.windows: dict[int, dict[int, set[str]]] = {}  # state -> window length -> items

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for the strings that p extends by word."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            cur = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = cur

    def walk(self, words: list[bytes]):
        """(state, length) of the longest match that ends at each word."""
        v = n = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            v = self.next[v].get(word, 0)
            n = n + 1 if v else 0
            yield v, n

    def mark(self, item: str | None, words: list[bytes], window: int) -> None:
        """Record the item's windows at the states that hold them; call after every add."""
        size = min(window, len(words))
        for v, n in self.walk(words):
            if n >= size:
                while self.length[self.link[v]] >= size:
                    v = self.link[v]
                items = self.windows.setdefault(v, {}).setdefault(size, set())
                if item is not None:
                    items.add(item)

    def seal(self) -> None:
        """For each state the nearest state on its link path that holds windows, itself included."""
        self.holder = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.holder[v] = v if v in self.windows else self.holder[self.link[v]]

    def hits(self, words: list[bytes]):
        """(first word, end, items) of each window that occurs."""
        for i, (v, n) in enumerate(self.walk(words)):
            u = self.holder[v] if v else -1
            while u >= 0:
                most = n if u == v else self.length[u]
                for size, items in self.windows[u].items():
                    if size <= most:
                        yield i + 1 - size, i + 1, items
                u = self.holder[self.link[u]] if self.link[u] > 0 else -1


class Matcher:
    """Automaton of one block and the bitmap that goes before it."""

    def __init__(self, block: list[tuple[str | None, bytes]], window: int) -> None:
        w = K.words_of([t for _, t in block], K.ALNUM_LOWER)
        raw = w.raw.tobytes().lower()
        items = [(block[i][0], [raw[a:b] for a, b in zip(w.start[x:y], w.end[x:y], strict=True)]) for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)) if y > x]
        self.sam = SuffixAutomaton()
        for _, words in items:
            self.sam.add(words)
        for item, words in items:
            self.sam.mark(item, words, window)
        self.sam.seal()
        self.least = min((min(window, len(words)) for _, words in items), default=0)
        self.gram = min(2, self.least)
        if self.gram:
            inside = [K.gram_hashes(w.hash[x:y], self.gram) for x, y in zip(w.first[:-1], w.first[1:], strict=True) if y > x]
            grams = np.concatenate(inside)
            self.bits = max(16, int(64 * len(grams)).bit_length())
            self.bitmap = np.zeros(1 << self.bits, dtype=bool)
            self.bitmap[grams >> np.uint64(64 - self.bits)] = True

    def match(self, texts: list[bytes]):
        """(words, hit mask, items) of each text."""
        for lo, hi in K.chunks(texts):
            w = K.words_of(texts[lo:hi], K.ALNUM_LOWER)
            hit = np.zeros(len(w.hash), dtype=bool)
            items: dict[int, set[str]] = {}
            if self.least and len(w.hash) >= self.least:
                grams = K.gram_hashes(w.hash, self.gram)
                able = self.bitmap[grams >> np.uint64(64 - self.bits)]
                if self.gram == 2:  # a pair of two texts is no pair
                    able[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] <= len(able))] - 1] = False
                edges = np.flatnonzero(np.diff(able.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                begin, end = edges[0::2], edges[1::2] + (self.gram - 1)
                long = end - begin >= self.least
                texts_at = np.searchsorted(w.first, begin[long], side="right") - 1
                for a, b, t in zip(begin[long].tolist(), end[long].tolist(), texts_at.tolist(), strict=True):
                    run = w.raw[w.start[a] : w.end[b - 1]].tobytes().lower()
                    base = int(w.start[a])
                    words = [run[x - base : y - base] for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                    last = int(w.first[t + 1])
                    if self.gram == 1 and b > last:  # single words: a run may cross into later texts
                        cuts = [a, *[int(x) for x in w.first if a < x < b], b]
                    else:
                        cuts = [a, b]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        at = int(np.searchsorted(w.first, x, side="right")) - 1
                        for s, e, found in self.sam.hits(words[x - a : y - a]):
                            hit[x + s : x + e] = True
                            items.setdefault(at, set()).update(found)
            for i in range(hi - lo):
                yield hit[w.first[i] : w.first[i + 1]], items.get(i, set())


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS):
    """Lists of (item id as text, text bytes), of at most `block_words` words each or one item."""
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for item, data in benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("binary")).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(K.words_of([bytes(data)], K.ALNUM_LOWER, hashed=False).start)
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item, bytes(data)))
        size += n
    if block:
        yield block


_built: dict[str, Matcher] = {}

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, found: str = "found", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with a struct column `found`: n_words, hit word spans, ids of items with occurring windows.

    A null text or one without words has no words and no hits.  Items without words match
    nothing; items of equal text are all listed; an item id that is null is not listed,
    though its windows count.  An empty benchmark hits nothing.  A document row that is
    repeated gives its row again; other columns, whatever their names, stay as they are (a
    column already named `found` is an error).
    """
    found = new_column(docs, found, "found")
    sc, out, names = docs.sparkSession.sparkContext, docs, docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(found, _FOUND)])
    found_blocks = blocks(benchmark, item_id, item_text, block_words)
    for i, block in enumerate(itertools.chain([next(found_blocks, [])], found_blocks)):
        if i:
            out = cut(out, "matched")
        shared = sc.broadcast(block)
        key = uuid.uuid4().hex

        def run(batches, shared=shared, key=key, first=not i):
            if key not in _built:
                _built.clear()
                _built[key] = Matcher(shared.value, window)
            matcher = _built[key]
            for batch in batches:
                data = [x or b"" for x in texts_of(batch, text)]
                before = [None] * len(data) if first else batch.column(found).to_pylist()
                rows = []
                for (hit, items), old in zip(matcher.match(data), before, strict=True):
                    if old:
                        hit = hit.copy()
                        for s in old["spans"]:
                            hit[s["start"] : s["end"]] = True
                        items = items | set(old["items"])
                    edges = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                    rows.append({"n_words": len(hit), "spans": [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)], "items": sorted(items)})
                kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
                columns = [batch.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*names, found])

        out = out.mapInArrow(tidy(run), schema)
    return out


def hit_words(found: str = "found"):
    """Column: words that windows cover."""
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(found: str = "found", min_share: tuple[int, int] = (1, 20)):
    """Column: some word is hit, and hit words are at least the given share of all words."""
    a, b = min_share
    return (hit_words(found) > 0) & (b * hit_words(found) >= a * F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", action: str = "drop", min_span: int = 13, min_share: tuple[int, int] = (1, 20), **options) -> DataFrame:
    """`docs` without contamination, in their own columns.

    action "drop": documents whose hit words reach `min_share` of their words go, the others
    stay untouched.  action "cut": every hit span of at least `min_span` words is cut from
    the text (with the characters between its words), whatever the share.
    """
    found = fresh(docs, "found")
    matched = match_benchmark(docs, benchmark, text=text, found=found, **options)
    if action == "drop":
        return matched.where(~contaminated(found, min_share)).drop(found)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            new = []
            for data, hit in zip(texts_of(batch, text), batch.column(found).to_pylist(), strict=True):
                spans = [s for s in hit["spans"] if s["end"] - s["start"] >= min_span]
                if spans:
                    w = K.words_of([data], K.ALNUM_LOWER, hashed=False)
                    keep, begin = [], 0
                    for s in spans:
                        keep.append(data[begin : w.start[s["start"]]])
                        begin = int(w.end[s["end"] - 1])
                    data = b"".join([*keep, data[begin:]])
                new.append(data)
            columns = [pa.array(new, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return matched.mapInArrow(tidy(run), docs.schema)
