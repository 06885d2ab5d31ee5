"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte n-grams (2 to 4 bytes, ASCII letters
lowered, other ASCII runs as spaces), hashed into `BUCKETS` rows; a linear softmax follows.
Both are trained by stochastic gradient descent in numpy on the driver from a bounded
sample.  A temperature is then fitted on a tenth of the sample that training did not see,
and the rejection threshold is the least score from which accepted texts of that tenth
reach the wanted accuracy.

Scale: the model is 2**14 rows of embeddings whatever the corpus size.  The sample is at
most `SAMPLE_PER_LANG` documents a language, each brought to the driver as at most 2**14
hashed counts, so no text length matters.  Prediction is one map-only pass over whole
texts; with the softmax's weights folded into the embeddings it is one table lookup a gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as K
from .common import new_column, texts_of, tidy

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Documents of each language that training may see, drawn by a hash of the id.
SAMPLE_PER_LANG = 500
_ORDERS = (2, 3, 4)
_GAP = b"   "
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the grams that start at each byte of the texts, for each order; and each text's first byte among them.

    Behind a text its grams read spaces, never the next text.
    """
    raw = _FOLD[np.frombuffer(_GAP.join(data) + _GAP, dtype=np.uint8)].astype(np.uint64)
    lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    first = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lengths, out=first[1:])
    own = np.arange(first[-1]) + np.repeat(np.arange(len(data)) * len(_GAP), lengths) if len(data) > 1 else slice(0, first[-1])
    out, code = [], raw
    for n in range(2, max(_ORDERS) + 1):
        code = code[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1 :]
        if n in _ORDERS:
            h = (code[own] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return out, first


def has_letter(data: bytes) -> bool:
    """Some character of the text is a letter."""
    if not data:
        return False
    if np.any((np.frombuffer(data, dtype=np.uint8) | 32) - 97 < 26):
        return True
    return any(map(str.isalpha, data.decode("utf-8", "replace").replace("�", "")))


def pieces(data: bytes):
    """Buckets of one text's grams, order by order, a piece of the text at a time (pieces overlap by what a gram needs)."""
    for lo in range(0, max(1, len(data)), K.CHUNK_BYTES):
        per_order, _ = grams([data[lo : lo + K.CHUNK_BYTES + max(_ORDERS) - 1]])
        for h in per_order:
            yield h[: K.CHUNK_BYTES]


def counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for h in pieces(data):
        total += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int32)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float) -> None:
        self.langs, self.table, self.bias, self.temperature, self.reject_below = langs, table.astype(np.float32), bias, temperature, reject_below

    def probabilities(self, data: list[bytes]) -> np.ndarray:
        out = np.empty((len(data), len(self.langs)))
        for lo, hi in K.chunks(data):
            size = np.array([max(1, len(x)) for x in data[lo:hi]])
            sums = np.zeros((hi - lo, len(self.langs)))
            if len(data[lo]) > K.CHUNK_BYTES:
                sums[0] = sum(np.bincount(h, minlength=BUCKETS) for h in pieces(data[lo])) @ self.table
            else:
                per_order, first = grams(data[lo:hi])
                some = np.flatnonzero(np.diff(first))
                for h in per_order if len(some) else ():
                    sums[some] += np.add.reduceat(self.table[h], first[:-1][some], axis=0)
            logits = (sums / (len(_ORDERS) * size)[:, None] + self.bias) / self.temperature
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[lo:hi] = e / e.sum(axis=1, keepdims=True)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 12, rate: float = 20.0, accuracy: float = 0.99, seed: int = 7) -> Model:
    """Embeddings and softmax from (language, buckets, counts); a tenth is kept for calibration."""
    langs = sorted({lang for lang, _, _ in sample})
    if not langs:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(lang) for lang, _, _ in sample])
    shares = [c / c.sum() if len(c) else c.astype(float) for _, _, c in sample]
    order = rng.permutation(len(sample))
    held, seen = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    soft, bias = rng.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(seen):
            at, share = sample[i][1], shares[i]
            mean = share @ emb[at]
            error = _softmax(mean @ soft + bias)
            error[y[i]] -= 1
            back = soft @ error
            soft -= 0.05 * step * np.outer(mean, error)
            bias -= 0.01 * error
            emb[at] -= step * share[:, None] * back
    table = emb @ soft
    logits = np.array([shares[i] @ table[sample[i][1]] + bias for i in held]).reshape(len(held), len(langs))
    temperature, reject = 1.0, 0.0
    if len(held):
        losses = {t: -np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(held)), y[held]])).mean() for t in np.geomspace(0.25, 8, 21)}
        temperature = float(min(losses, key=losses.get))
        p = _softmax(logits / temperature)
        best = np.argsort(-p.max(axis=1))
        right = np.cumsum((p.argmax(axis=1) == y[held])[best]) / np.arange(1, len(best) + 1)
        good = np.flatnonzero(right >= accuracy)
        reject = float(p.max(axis=1)[best[good[-1]]]) if len(good) else 1.0
    return Model(langs, table, bias, temperature, reject)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, **options) -> Model:
    """Train on at most about `per_lang` documents of each language (rows with text and language)."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), (F.xxhash64(key).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    drawn = rows.where(F.col("u") < share[F.col("l")])

    def run(batches):
        for batch in batches:
            found = [counts(x) for x in texts_of(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("u"), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in found], pa.list_(pa.int32()))], names=["l", "u", "a", "c"])

    got = drawn.mapInArrow(tidy(run), "l string, u double, a array<int>, c array<int>").toArrow()
    order = np.lexsort((got["u"].to_numpy(), np.array(got["l"].to_pylist(), dtype=object).astype(str)))
    lists = [(x.as_py(), np.array(a.as_py(), dtype=np.int32), np.array(c.as_py(), dtype=np.int32)) for x, a, c in zip(got["l"], got["a"], got["c"], strict=True)]
    return train([lists[i] for i in order], **options)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str | None = None) -> DataFrame:
    """`docs` with a struct column `language`: lang, score, confident.

    A text that is null or has no letter is `und` with score 0 and not confident.  Other texts
    get the likeliest learned language; `confident` is false where its calibrated probability
    is under the model's rejection threshold, which a filter may take as "no answer".  With no
    learned language every text is `und`.  Repeated rows give the same answer; other columns
    stay as they are.
    """
    out = new_column(docs, out, "language")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confident", T.BooleanType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            data = [x or b"" for x in texts_of(batch, text)]
            p = m.probabilities(data)
            letters = np.array([has_letter(x) for x in data], dtype=bool) & (m.langs != ["und"])
            best = p.argmax(axis=1) if len(data) else np.empty(0, dtype=int)
            score = np.where(letters, np.minimum(1.0, p.max(axis=1, initial=0.0)), 0.0)
            lang = [m.langs[b] if x else "und" for b, x in zip(best, letters, strict=True)]
            answer = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(letters & (score >= m.reject_below))], names=["lang", "score", "confident"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], answer], names=[*names, out])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, kind)]))
