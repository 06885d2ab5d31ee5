"""Toxicity by a linear-chain conditional random field over words.

Each word is tagged O or T (toxic).  Emissions come from hashed features of the word: the
word itself, its first 3 to 10 bytes, its last 3, and the words beside it; transitions are
a 2 x 2 table.  Forward-backward gives each word's marginal probability of T; a document's
score is a calibrated logistic of its largest marginal and its number of tagged words, and runs of words over one half are
the offending spans, with byte offsets.

Labels are of documents, training needs words: a word of a toxic training document is
labelled T if one of its own features marks toxicity in the sample (the log-likelihood ratio
of its document counts exceeds `MARK_RATIO`, and its rate in toxic documents is `MARK_LIFT`
times that in others); toxic documents without such a word are left out of training.  The field then learns from these labelled words.

Scale: the model is 2**17 weights whatever the corpus size and is trained in numpy on the
driver from a bounded sample: at most about `SAMPLE_TOXIC` and `SAMPLE_CLEAN` documents, none
over `SAMPLE_TEXT_BYTES` (for training only).  Scoring is one map-only pass over whole texts;
words are array elements, never Python objects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as K
from .common import new_column, texts_of, tidy

FEATURE_BITS = 17
#: Training documents of each label, drawn by a hash of the id, and the most bytes of one.
SAMPLE_TOXIC = 800
SAMPLE_CLEAN = 1800
SAMPLE_TEXT_BYTES = 65_536
#: Bytes of all training texts at most.
SAMPLE_BYTES = 24 << 20
#: Of features that mark toxicity: the least log-likelihood ratio, about 2 ln(distinct features of a sample), and the least lift.
MARK_RATIO = 24.0
MARK_LIFT = 12.0
#: The score from which a document counts as toxic.
CUT = 0.7
_PREFIXES = (3, 4, 5, 6, 8, 10)
_OWN = 2 + len(_PREFIXES)  # features of the word itself; two of its neighbours follow


def feature_rows(w: K.Words):
    """Weight indices of all words, one feature after the other: `_OWN` of the word itself, then two of its neighbours."""
    n = len(w.hash)
    pw, _ = K._power_table(max(_PREFIXES))

    def index(h: np.ndarray, kind: int) -> np.ndarray:
        return (K.mix(h + np.uint64(kind * 0x51_7CC1B727220A95 & K._MASK)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)

    def add(h: np.ndarray, begin: np.ndarray, j: int) -> None:
        inside = np.flatnonzero(begin + j < w.end)
        h[inside] += K.ALNUM_LOWER[w.raw[begin[inside] + j]].astype(np.uint64) * pw[j]

    yield index(w.hash, 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(max(_PREFIXES)):
        add(h, w.start, j)
        if j + 1 in _PREFIXES:
            yield index(h, 3 + _PREFIXES.index(j + 1))
    h[:] = 0
    for j in range(3):
        add(h, np.maximum(w.end - 3, w.start), j)
    yield index(h, 2)
    inner = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < n)]
    h = np.zeros(n, dtype=np.uint64)
    h[1:] = w.hash[:-1]
    h[inner] = 0
    yield index(h, 20)
    h = np.zeros(n, dtype=np.uint64)
    h[:-1] = w.hash[1:]
    h[inner - 1] = 0
    yield index(h, 21)


def features(w: K.Words) -> np.ndarray:
    """(features, words) array of weight indices."""
    return np.stack(list(feature_rows(w)))


#: Words from which a text is walked in parts, side by side.
PART = 512


def _apply(m: np.ndarray, x: float) -> float:
    return float((m[0] * x + m[1]) / (m[2] * x + m[3]))


def _products(steps, n: int) -> np.ndarray:
    """Products of 2 x 2 matrices, one a column, each scaled so that nothing over- or underflows.

    `steps` gives (columns, entries): what is multiplied from the left onto some columns next.
    """
    out = np.zeros((4, n))
    out[0] = out[3] = 1.0
    for at, (a, b, c, d) in steps:
        p, q, r, s = out[:, at]
        new = np.stack([a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s])
        out[:, at] = new / new.sum(axis=0)
    return out


def _parts(e: np.ndarray, first: np.ndarray, t: np.ndarray):
    """Begins and lengths of the texts' parts, and the odds that enter each from the left and from the right (nan at a text's ends).

    A walk over a word maps the odds by a 2 x 2 matrix.  The products over parts, of all parts side by side, are
    chained text by text; so a text of n words takes about PART + n / PART steps, not n.
    """
    length = np.diff(first)
    if not len(length) or length.max() <= PART:
        none = np.full(len(length), np.nan)
        return first[:-1], length, none, none
    counts = np.maximum(1, -(-length // PART))
    text = np.repeat(np.arange(len(length)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = first[text] + number * PART
    size = np.minimum(first[text + 1] - begin, PART)
    left, right = np.full(len(text), np.nan), np.full(len(text), np.nan)
    some = np.flatnonzero(counts[text] > 1)
    lead, last = number[some] == 0, number[some] == counts[text[some]] - 1

    def forward():
        for s in range(PART):
            at = np.flatnonzero((size[some] > s) & ~(lead & (s == 0)))
            x = e[begin[some[at]] + s]
            yield at, (t[1, 1] * x, t[0, 1] * x, np.full(len(at), t[1, 0]), np.full(len(at), t[0, 0]))

    def backward():
        for s in range(1, PART + 1):  # the word s from the end takes what comes from the one behind it
            at = np.flatnonzero((size[some] >= s) & ~(last & (s == 1)))
            x = e[begin[some[at]] + size[some[at]] - s + 1]
            yield at, (t[1, 1] * x, np.full(len(at), t[1, 0]), t[0, 1] * x, np.full(len(at), t[0, 0]))

    m, w = _products(forward(), len(some)), _products(backward(), len(some))
    odds = 0.0
    for k, i in enumerate(some.tolist()):
        if lead[k]:
            odds = float(e[begin[i]])
        else:
            left[i] = odds
        odds = _apply(m[:, k], odds)
    for k, i in zip(range(len(some) - 1, -1, -1), some[::-1].tolist(), strict=True):
        if last[k]:
            odds = 1.0
        else:
            right[i] = odds
        odds = _apply(w[:, k], odds)
    return begin, size, left, right


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(T) of each word by forward-backward; with `pairs`, also the expected transitions.

    `emit` is the log weight of T against O of each word, `first` the texts' offsets, `trans`
    the 2 x 2 log weights [from, to].  Messages are kept as the odds of T, so no sum under- or
    overflows; texts, and the parts of long ones, are walked side by side, longest first.
    """
    t = np.exp(trans)
    e = np.exp(np.clip(emit, -30, 30))
    begin, length, left, right = _parts(e, first, t)
    order = np.argsort(-length, kind="stable")
    begin, length, left, right = begin[order], length[order], left[order], right[order]
    f, b = np.empty(len(emit)), np.ones(len(emit))
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), side="left")  # parts longer than each step
    forward = lambda odds, at: (t[0, 1] + odds * t[1, 1]) / (t[0, 0] + odds * t[1, 0]) * e[at]
    odds = None
    for s in range(steps):
        at = begin[: live[s]] + s
        if s:
            odds = forward(odds[: live[s]], at)
        else:
            enter = left[: live[s]]
            odds = np.where(np.isnan(enter), e[at], forward(np.nan_to_num(enter), at))
        f[at] = odds
    end = begin + length - 1
    inner = np.flatnonzero(~np.isnan(right))
    q = e[end[inner] + 1] * right[inner]
    odds = np.ones(len(length))
    odds[inner] = (t[1, 0] + t[1, 1] * q) / (t[0, 0] + t[0, 1] * q)
    b[end[inner]] = odds[inner]
    for s in range(1, steps):
        at = end[: live[s]] - s
        q = e[at + 1] * odds[: live[s]]
        odds = (t[1, 0] + t[1, 1] * q) / (t[0, 0] + t[0, 1] * q)
        b[at] = odds
    m = f * b
    p = m / (1 + m)
    if not pairs:
        return p
    joint = np.zeros((2, 2))
    inside = np.ones(max(0, len(emit) - 1), dtype=bool)
    cut = first[1:-1]
    inside[cut[(cut > 0) & (cut < len(emit))] - 1] = False
    i = np.flatnonzero(inside)
    x, q = f[i], e[i + 1] * b[i + 1]
    z = t[0, 0] + t[0, 1] * q + x * (t[1, 0] + t[1, 1] * q)
    for r in (0, 1):
        for c in (0, 1):
            joint[r, c] = ((x if r else 1.0) * t[r, c] * (q if c else 1.0) / z).sum()
    return p, joint


class Model:
    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, scale: float, shift: float) -> None:
        self.weights, self.bias, self.trans, self.scale, self.shift = weights.astype(np.float32), bias, trans, scale, shift

    def emissions(self, w: K.Words) -> np.ndarray:
        total = np.full(len(w.hash), self.bias, dtype=np.float64)
        for row in feature_rows(w):
            total += self.weights[row]
        return total

    def raw_scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each text's largest marginal plus the log of 1 + words tagged T; texts without words have the least."""
        most, tagged = np.full(len(first) - 1, 1e-6), np.zeros(len(first) - 1)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            most[some] = np.maximum.reduceat(p, first[:-1][some])
            tagged[some] = np.add.reduceat((p > 0.5).astype(float), first[:-1][some])
        most = np.clip(most, 1e-6, 1 - 1e-6)
        return np.log(most / (1 - most)) + np.log1p(tagged)

    def tag(self, data: list[bytes]):
        """(score, spans) of each text; a span is (first byte, end byte, largest marginal)."""
        for lo, hi in K.chunks(data):
            w = K.words_of(data[lo:hi], K.ALNUM_LOWER)
            p = marginals(self.emissions(w), w.first, self.trans)
            score = 1 / (1 + np.exp(-(self.scale * self.raw_scores(p, w.first) + self.shift)))
            text_at = np.zeros(hi - lo + 1, dtype=np.int64)
            np.cumsum([len(x) + 1 for x in data[lo:hi]], out=text_at[1:])
            hot = np.flatnonzero(p > 0.5)
            own = np.searchsorted(w.first, hot, side="right") - 1
            spans: dict[int, list[list[float]]] = {}
            last = (-1, -2)
            for i, t in zip(hot.tolist(), own.tolist(), strict=True):
                a, b = int(w.start[i] - text_at[t]), int(w.end[i] - text_at[t])
                if last == (t, i - 1):
                    spans[t][-1][1] = b
                    spans[t][-1][2] = max(spans[t][-1][2], float(p[i]))
                else:
                    spans.setdefault(t, []).append([a, b, float(p[i])])
                last = (t, i)
            for i in range(hi - lo):
                yield float(score[i]), spans.get(i, [])


def _ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Log-likelihood ratio of document counts a of n_a and b of n_b against one common rate."""
    rate = (a + b) / (n_a + n_b)

    def part(x: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(x > 0, x * np.log(x / (n * rate)), 0.0)
            outside = np.where(x < n, (n - x) * np.log((n - x) / (n * (1 - rate))), 0.0)
        return np.nan_to_num(inside + outside)

    return 2 * (part(a, n_a) + part(b, n_b))


def label_words(x: np.ndarray, first: np.ndarray, toxic: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """Which words of toxic documents are labelled T, by the counts of the documents to fit."""
    texts = np.repeat(np.arange(len(toxic)), np.diff(first))
    size = 1 << FEATURE_BITS
    marks = np.zeros(x.shape[1], dtype=bool)
    n_tox, n_ok = int((toxic & fitted).sum()), int((~toxic & fitted).sum())
    some = np.flatnonzero(fitted[texts])
    for row in x[:_OWN]:
        seen = np.unique(texts[some].astype(np.int64) * size + row[some])
        doc, f = seen // size, seen % size
        a = np.bincount(f[toxic[doc]], minlength=size)
        b = np.bincount(f[~toxic[doc]], minlength=size)
        marking = (_ratio(a, b, n_tox, n_ok) >= MARK_RATIO) & ((a + 0.1) / n_tox >= MARK_LIFT * (b + 0.1) / n_ok)
        marks |= marking[row]
    return marks & toxic[texts]


def train(texts: list[bytes], toxic: list[int], share: float | None = None, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6, seed: int = 11) -> Model:
    """CRF weights by minibatch gradient (AdaGrad) on labelled words, then the score's calibration.

    `share` is the corpus' share of toxic documents, where the sample's own differs.
    """
    toxic = np.array(toxic, dtype=bool)
    size = 1 << FEATURE_BITS
    weights, trans, bias = np.zeros(size), np.zeros((2, 2)), -3.0
    if not len(texts) or not toxic.any() or toxic.all():
        base = (toxic.sum() + 0.5) / (len(toxic) + 1) if share is None else min(0.99, max(0.01, share))
        return Model(weights, bias, trans, 0.0, float(np.log(base / (1 - base))))
    parts, offsets = [], [np.zeros(1, dtype=np.int64)]
    for lo, hi in K.chunks(texts):
        w = K.words_of(texts[lo:hi], K.ALNUM_LOWER)
        parts.append(features(w))
        offsets.append(offsets[-1][-1] + w.first[1:])
    x, first = np.concatenate(parts, axis=1), np.concatenate(offsets)
    del parts, offsets, w
    held = np.zeros(len(texts), dtype=bool)  # every fourth text of each label calibrates the score
    for some in (np.flatnonzero(toxic), np.flatnonzero(~toxic)):
        held[some[3::4]] = True
    if not toxic[held].any() or toxic[held].all():
        held[:] = True
        fitted = np.ones(len(texts), dtype=bool)
    else:
        fitted = ~held
    y = label_words(x, first, toxic, fitted)
    labelled = np.zeros(len(texts), dtype=bool)
    labelled[np.searchsorted(first, np.flatnonzero(y), side="right") - 1] = True
    use = np.flatnonzero(fitted & (labelled | ~toxic) & (np.diff(first) > 0))
    use = use[np.argsort(np.diff(first)[use], kind="stable")]  # batches of like length
    batches = [use[i : i + 48] for i in range(0, len(use), 48)]
    rng = np.random.default_rng(seed)
    square, square_t, square_b = np.full(size, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            rows = batches[k]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in rows])
            off = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
            some = x[:, at]
            emit = weights[some].sum(axis=0) + bias
            p, joint = marginals(emit, off, trans, pairs=True)
            g = y[at] - p
            scale = 1.0 / len(rows)
            grad = np.bincount(some.ravel(), weights=np.tile(g, len(x)), minlength=size) * scale - l2 * weights
            now = np.zeros((2, 2))
            inside = np.ones(len(at) - 1, dtype=bool)
            inside[off[1:-1] - 1] = False
            np.add.at(now, (y[at][:-1][inside].astype(int), y[at][1:][inside].astype(int)), 1.0)
            grad_t = (now - joint) * scale
            grad_b = g.sum() * scale
            square += grad * grad
            square_t += grad_t * grad_t
            square_b += grad_b * grad_b
            weights += rate * grad / np.sqrt(square) * (grad != 0)
            trans = np.clip(trans + rate * grad_t / np.sqrt(square_t), -6, 6)
            bias += rate * grad_b / np.sqrt(square_b)
    model = Model(weights, float(bias), trans, 1.0, 0.0)
    emit = np.full(x.shape[1], model.bias)
    for row in x:
        emit += model.weights[row]
    z = model.raw_scores(marginals(emit, first, trans), first)
    model.scale, model.shift = calibrate(z[held], toxic[held], share)
    return model


def calibrate(z: np.ndarray, toxic: np.ndarray, share: float | None) -> tuple[float, float]:
    """Slope by Platt's logistic of z (Newton steps), with the classes weighted to the corpus' share of toxic;
    the shift puts the cut of best F1 at a score of `CUT`."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = n1 / (n1 + n0) if share is None else share
    weight = np.where(toxic, share / max(1, n1), (1 - share) / max(1, n0)) * len(z)
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (target - q), weight * q * (1 - q) + 1e-6
        m = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, np.array([(g * z).sum(), g.sum()]))
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = max(0.05, a + step * da), b + step * db
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum((weight * toxic)[order])
    taken = np.cumsum(weight[order])
    f1 = 2 * hits / (taken + (weight * toxic).sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # no cut between equal values
    best = int(f1.argmax())
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1.0
    cut = (z[order][best] + below) / 2
    return float(a), float(np.log(CUT / (1 - CUT)) - a * cut)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN, text_bytes: int = SAMPLE_TEXT_BYTES, **options) -> Model:
    """Train on a bounded sample of labelled documents; a null label or text counts as no row.

    The sample is drawn by a hash of the key, and cut (where keys repeat) in the order of hashes; of
    its texts those are taken, in that order, that together have at most `SAMPLE_BYTES` bytes.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, (toxic_rows if y else clean_rows) / n))).otherwise(share)
    drawn = marked.withColumn("u", F.xxhash64("k").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).where(F.col("u") < share)
    pool = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= text_bytes))
    chosen = pool.join(F.broadcast(drawn), "k").select("k", "y", "t").orderBy(F.xxhash64("k"), F.xxhash64("t")).limit(2 * (toxic_rows + clean_rows))
    got, size = [], 0
    for r in chosen.toLocalIterator():
        size += len(r["t"])
        if size > SAMPLE_BYTES:
            break
        got.append((r["k"], r["y"], bytes(r["t"])))
    got.sort()
    return train([t for _, _, t in got], [y for _, y, _ in got], share=sizes.get(1, 0) / max(1, sum(sizes.values())), **options)


def score(docs: DataFrame, model: Model, text: str = "text", out: str | None = None) -> DataFrame:
    """`docs` with a struct column: score and spans (byte offsets in the text, largest marginal).

    A null text or one without words has the score of a text whose words are all surely O, and
    no spans.  Repeated rows give the same answer; other columns stay as they are.
    """
    out = new_column(docs, out, "toxicity")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches):
        arrow = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))])
        for batch in batches:
            data = [x or b"" for x in texts_of(batch, text)]
            rows = [{"score": s, "spans": [{"start": a, "end": b, "marginal": p} for a, b, p in spans]} for s, spans in shared.value.tag(data)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, arrow)], names=[*names, out])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, kind)]))
