"""Licence scan: Dice coefficients of word bigrams between text segments and licence templates.

A text's segments are its lines, its paragraphs (between blank lines), the whole and every run of
words; copyright lines are left out of the longer ones, and runs are taken with and without them.  Segments and templates are lowered words (letters, digits, all
that is not ASCII) and are compared as sets of word bigrams: Dice = 2 |A and B| / (|A| + |B|).  A
segment with a bigrams can only reach t with templates of between a t / (2 - t) and a (2 - t) / t
bigrams; within those bounds it must hold enough bigrams that any template has at all, and
what is left is compared with each template in bounds.

The best run for a template begins and ends with one of its bigrams, holds at least s t / (2 - t) of
its s bigrams and at most s (2 / t - 2) others.  Only a text with so many of them is looked at, and
there each beginning, up to where the others are too many; runs of any length and form are found.
Of licences whose texts are alike (`RIVALS`) only the best match of a place is reported.

Scale: the templates are a fixed list, sent to the executors once; documents take one map-only
pass, and bounds are array expressions over all segments of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens as K
from .common import new_column, texts_of, tidy
from .licence_templates import RIVALS, TEMPLATES

MIN_DICE = 0.9
_BITS = 20


def bigrams(text: bytes) -> np.ndarray:
    """Sorted distinct hashed word bigrams of a text; one word alone is a bigram of its own."""
    h = K.words_of([text], K.ALNUM_LOWER).hash
    return np.unique(K.gram_hashes(h, 2) if len(h) > 1 else K.gram_hashes(h, 1, seed=1))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], min_dice: float) -> None:
        self.names = [n for n, _ in templates]
        self.sets = [bigrams(t.encode()) for _, t in templates]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.min_dice = min_dice
        self.least = np.ceil(self.sizes * min_dice / (2 - min_dice) - 1e-9).astype(np.int64)
        # bigrams of templates of two words or more, and the templates of each
        pairs = [(s, k) for k, (s, (_, t)) in enumerate(zip(self.sets, templates, strict=True)) if len(K.words_of([t.encode()], K.ALNUM_LOWER).hash) > 1]
        every = np.concatenate([s for s, _ in pairs]) if pairs else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.of = np.repeat([k for _, k in pairs], [len(s) for s, _ in pairs])[order].astype(np.int64)
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.known = np.zeros(1 << _BITS, dtype=bool)
        for s in self.sets:
            self.known[s >> np.uint64(64 - _BITS)] = True

    def dice(self, own: np.ndarray):
        """(template, Dice) of the templates that a set of bigrams reaches."""
        t = self.min_dice
        for k in np.flatnonzero((self.sizes >= len(own) * t / (2 - t) - 1e-9) & (self.sizes <= len(own) * (2 - t) / t + 1e-9)).tolist():
            both = len(np.intersect1d(own, self.sets[k], assume_unique=True))
            value = 2 * both / (len(own) + int(self.sizes[k]))
            if value >= t:
                yield k, value

    def scan(self, texts: list[bytes]):
        """Matches of each text: (licence, Dice, scope, first byte, end byte), best first."""
        if not self.sets:
            yield from ([] for _ in texts)
            return
        for lo, hi in K.chunks(texts):
            data = texts[lo:hi]
            found: list[dict] = [{} for _ in data]
            w = K.words_of(data, K.ALNUM_LOWER)
            base = np.zeros(len(data), dtype=np.int64)
            np.cumsum([len(x) + 1 for x in data[:-1]], out=base[1:])
            grams = K.gram_hashes(w.hash, 2)
            for scope, owner, start, end in self._segments(data):
                self._compare(data, w, base, grams, scope, owner, start, end, found)
            doc = np.repeat(np.arange(len(data)), np.diff(w.first))
            self._runs(grams, w.start, w.end, doc, base, found)
            kept = self._without_copyright(data, w, base)
            if len(kept):
                self._runs(K.gram_hashes(w.hash[kept], 2), w.start[kept], w.end[kept], doc[kept], base, found)
            for matches in found:
                yield _without_rivals(sorted(((n, *m) for n, m in matches.items()), key=lambda m: (-m[1], m[3], m[0])))

    def _segments(self, data: list[bytes]):
        """Arrays of segments a scope: owner, first byte and end byte in the owner's text."""
        lines, paragraphs, wholes = [], [], []
        for i, x in enumerate(data):
            at = 0
            begin = None
            for line in x.split(b"\n"):
                if line.strip():
                    lines.append((i, at, at + len(line)))
                    begin = at if begin is None else begin
                    last = at + len(line)
                elif begin is not None:
                    paragraphs.append((i, begin, last))
                    begin = None
                at += len(line) + 1
            if begin is not None:
                paragraphs.append((i, begin, last))
            if x.strip():
                wholes.append((i, 0, len(x)))
        for scope, rows in (("line", lines), ("paragraph", paragraphs), ("whole", wholes)):
            if rows:
                yield scope, *(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))

    def _compare(self, data, w, base, grams, scope, owner, start, end, found) -> None:
        a = np.searchsorted(w.start, start + base[owner])
        b = np.searchsorted(w.start, end + base[owner])
        t = self.min_dice
        pairs = self.known[grams >> np.uint64(64 - _BITS)]
        hits = np.zeros(len(w.hash) + 1, dtype=np.int64)
        np.cumsum(pairs, out=hits[1 : len(pairs) + 1])
        hits[len(pairs) + 1 :] = hits[len(pairs)]
        inside = hits[np.maximum(a, b - 1)] - hits[a]  # bigrams that some template has, an upper bound of any overlap
        marks = np.array([x.lower().count(b"copyright") for x in data], dtype=np.int64)  # each line left out may join two words
        for k in np.flatnonzero((b - a == 1) | (inside + marks[owner] >= self.sizes.min() * t / (2 - t) - 1e-9)).tolist():
            i = int(owner[k])
            text = data[i][start[k] : end[k]]
            if scope != "line":
                if b"\n" not in text.strip(b"\n"):
                    continue  # its one line is a segment already
                if marks[i]:
                    text = b"\n".join(x for x in text.split(b"\n") if not x.strip().lower().startswith(b"copyright"))
            own = bigrams(text)
            if not len(own):
                continue
            for k_, value in self.dice(own):
                name = self.names[k_]
                if name not in found[i] or value > found[i][name][0]:
                    found[i][name] = (value, scope, int(start[k]), int(end[k]))

    def _without_copyright(self, data, w, base) -> np.ndarray:
        """Words outside copyright lines, of the texts that have such lines."""
        kept = []
        for i, x in enumerate(data):
            if b"copyright" not in x.lower():
                continue
            words = np.arange(w.first[i], w.first[i + 1])
            keep = np.ones(len(words), dtype=bool)
            at = int(base[i])
            for line in x.split(b"\n"):
                if line.strip().lower().startswith(b"copyright"):
                    lo, hi = np.searchsorted(w.start[words], [at, at + len(line)])
                    keep[lo:hi] = False
                at += len(line) + 1
            if not keep.all():
                kept.append(words[keep])
        return np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)

    def _runs(self, grams, start, end, doc, base, found) -> None:
        """The best run of words for each template, where it beats what was found before."""
        if not len(self.grams) or not len(grams):
            return
        at = np.flatnonzero(self.known[grams >> np.uint64(64 - _BITS)] & (doc[1:] == doc[:-1]))
        gram = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        real = self.grams[gram] == grams[at]
        owner, gram = np.divmod(np.unique(doc[at[real]] * len(self.grams) + gram[real]), len(self.grams))
        n = self.first[gram + 1] - self.first[gram]
        places = np.repeat(self.first[gram] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both, count = np.unique(np.repeat(owner, n) * len(self.sets) + self.of[places], return_counts=True)
        owner, template = np.divmod(both, len(self.sets))
        for j in np.flatnonzero(count >= self.least[template]).tolist():
            i, k = int(owner[j]), int(template[j])
            lo, hi = np.searchsorted(doc, [i, i + 1]).tolist()
            run = self._best_run(grams[lo : hi - 1], k)
            if run is None:
                continue
            value, a, b = run
            match = (value, "words", int(start[lo + a] - base[i]), int(end[lo + b + 1] - base[i]))
            had = found[i].get(self.names[k])
            if had is None or value > had[0] or value == had[0] and had[1] == "words" and match[3] - match[2] > had[3] - had[2]:
                found[i][self.names[k]] = match

    def _best_run(self, grams: np.ndarray, k: int):
        """(Dice, first and last bigram) of the best run of a text's bigrams for a template, if one reaches it."""
        own_set, size, least = self.sets[k], int(self.sizes[k]), int(self.least[k])
        most = int(size * (2 / self.min_dice - 2) + 1e-9)
        own = own_set[np.minimum(np.searchsorted(own_set, grams), size - 1)] == grams
        hits = np.flatnonzero(own)
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1, dtype=np.int64)  # where the same bigram was last
        same = grams[order[1:]] == grams[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        wide = np.flatnonzero(np.diff(hits) - 1 > most).tolist()
        cuts = [0, *(c + 1 for c in wide if len(np.unique(grams[hits[c] + 1 : hits[c + 1]])) > most), len(hits)]
        best = None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < least or len(np.unique(grams[hits[lo:hi]])) < least:
                continue
            stop = int(hits[hi - 1]) + 1
            for a in hits[lo:hi].tolist():
                span = 2 * (size + most) + 64
                while True:
                    part = slice(a, min(stop, a + span))
                    new = before[part] < a
                    others = np.cumsum(new & ~own[part])
                    if part.stop == stop or others[-1] > most:
                        break
                    span *= 2
                shared = np.cumsum(new & own[part])[: np.searchsorted(others, most, side="right")]
                if shared[-1] < least:
                    if part.stop == stop and len(shared) == len(others):
                        break  # later beginnings have fewer
                    continue
                dice = 2 * shared / (shared + others[: len(shared)] + size)
                b = int(np.argmax(dice))
                if dice[b] >= self.min_dice and (best is None or dice[b] > best[0]):
                    best = (float(dice[b]), a, a + b)
                    if best[0] == 1.0:
                        return best
        return best


def _without_rivals(matches: list[tuple]) -> list[tuple]:
    """Matches, best first, less those that overlap a better one of a licence of like text."""
    kept: list[tuple] = []
    for m in matches:
        if not any(m[3] < k[4] and k[3] < m[4] and any(m[0] in r and k[0] in r for r in RIVALS) for k in kept):
            kept.append(m)
    return kept


def scan_licences(docs: DataFrame, text: str = "text", min_dice: float = MIN_DICE, templates: list[tuple[str, str]] | None = None, out: str | None = None) -> DataFrame:
    """`docs` with an array column of structs: licence, dice, scope, start, end (byte offsets), best first.

    A null or empty text and one without words match nothing.  A licence is listed once, with its best
    segment; of equal ones the first, lines before paragraphs before the whole before runs of words
(scope `words`; templates of one word have none).  Repeated rows
    give the same answer; other columns stay as they are.
    """
    out = new_column(docs, out, "licences")
    names = docs.columns
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, min_dice))
    fields = [("licence", T.StringType(), pa.string()), ("dice", T.DoubleType(), pa.float64()), ("scope", T.StringType(), pa.string()), ("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64())]

    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in fields]))
    arrow = [(n, t) for n, _, t in fields]

    def run(batches):
        for batch in batches:
            data = [x or b"" for x in texts_of(batch, text)]
            rows = [[dict(zip([n for n, _ in arrow], m, strict=True)) for m in matches] for matches in scanner.value.scan(data)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, pa.list_(pa.struct(arrow)))], names=[*names, out])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, kind)]))
