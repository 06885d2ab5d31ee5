"""Sequence packing along a space-filling curve.

Each document's words are hashed to pseudo-random vectors of a few dimensions; their scaled
sum is the document's place, and its Hilbert index the sort key.  Documents are dealt into
ranges of the key, sorted within each, and packed in that order, so that documents of like
vocabulary share sequences.  Documents are cut freely; a range's last sequence is cut at
powers of two, which need no padding.

Scale: the key ends in bits of the id's hash, so copies of one document, which share a
place, spread over ranges.  Range bounds are weighted quantiles of at most about
`SAMPLE_ROWS` sampled keys (8 bytes each); texts are tokenised once, token ids are shuffled
once, and a range is sorted by Spark (spilling where it must) and packed as a stream.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import shuffle_partitions, texts_of, tidy

DIMS, DIM_BITS = 3, 10
SAMPLE_ROWS = 8192
#: Bytes of text in a range at most on average, and what a document weighs beside its bytes.
RANGE_BYTES, ROW_WEIGHT = 128 << 20, 256
#: Parts of a range's sequence ids: range number, then the sequence in it.
_RANGE_SHIFT = 40
#: How byte-level vocabularies are split before merging (fixed value of the public format).
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a text may be cut before splitting, and the characters that are encoded at a time.
_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
PIECE_CHARS = 1 << 19
_PROBES = ["Plain words, 12345 and  double  spaces.", "don't we'll\n\n\tnew lines éñ中\U0001f600 !!", ""]

_encoders: dict[str, object] = {}


def _byte_of_char() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from a list of texts to lists of ids, as the tokenizers library gives them for the file.

    A byte-level BPE file is run by tiktoken, about seven times as fast, after both libraries agree on
    probe texts, with and without added tokens; any other file by tokenizers.  The literal of an added
    token, special or not, is that token.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_tokenizers(texts: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids for t in texts]

    found = by_tokenizers
    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("packing", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)
    except (ImportError, KeyError, ValueError):
        pass
    else:

        def by_tiktoken(texts: list[str]) -> list[list[int] | np.ndarray]:
            return [piece(t) if len(t) <= PIECE_CHARS else np.concatenate([np.array(piece(p), dtype=np.uint32) for p in pieces(t)]) for t in texts]

        def piece(t: str) -> list[int]:
            return fast.encode(t, allowed_special="all") if any(x in t for x in special) else fast.encode_ordinary(t)

        def pieces(t: str):
            """Parts that the split never joins: they end before a space between letters."""
            at = 0
            while at < len(t):
                end = _BREAK.search(t, at + PIECE_CHARS) if len(t) - at > PIECE_CHARS else None
                stop = end.start() if end else len(t)
                yield t[at:stop]
                at = stop

        probes = [*_PROBES, *(p for x in special for p in (x, f"one {x} two", f"one  {x}\n {x}{x}two", f"a{x}b"))]
        if by_tiktoken(probes) == by_tokenizers(probes) and not any(_BREAK.search(x) for x in special):
            found = by_tiktoken
    _encoders[path] = found
    return found


def hilbert(points: np.ndarray, bits: int = DIM_BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) with `bits` bits a dimension."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the excess work of rotations, from the top bit
        q, low = 1 << b, (1 << b) - 1
        for k in range(n):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, n):  # Gray code
        x[k] = x[k] ^ x[k - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> b) & 1, t ^ ((1 << b) - 1), t)
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | (((x[k] ^ t) >> b) & 1)
    return out


def places(data: list[bytes]) -> np.ndarray:
    """Hilbert index of each text; a text without words is in the middle."""
    out = np.zeros(len(data), dtype=np.int64)
    for lo, hi in K.chunks(data):
        w = K.words_of(data[lo:hi], K.ALNUM_LOWER)
        n = np.diff(w.first)
        some = np.flatnonzero(n)
        grid = np.full((hi - lo, DIMS), 1 << (DIM_BITS - 1), dtype=np.int64)
        for k in range(DIMS):
            part = ((w.hash >> np.uint64(21 * k)) & np.uint64(0x1FFFFF)).astype(np.float64) / (1 << 20) - 1.0
            if len(some):
                z = np.add.reduceat(part, w.first[:-1][some]) * np.sqrt(3.0 / n[some])  # about standard normal
                grid[some, k] = np.clip(((np.tanh(0.8 * z) + 1) * (1 << (DIM_BITS - 1))).astype(np.int64), 0, (1 << DIM_BITS) - 1)
        out[lo:hi] = hilbert(grid)
    return out


def _keys(data: list[bytes], salt: np.ndarray) -> np.ndarray:
    return (places(data) << 32) | (salt & 0xFFFFFFFF)


def range_bounds(docs: DataFrame, key: str, text: str, ranges: int | None = None, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Upper bounds of the ranges but the last: weighted quantiles of sampled keys.

    Without a number of ranges it follows from the bytes, and is at least that of shuffle partitions.
    """
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    ranges = ranges or max(shuffle_partitions(docs.sparkSession), size // RANGE_BYTES + 1)
    if not total or ranges < 2:
        return np.empty(0, dtype=np.int64)
    share = min(1.0, max(rows, 8 * ranges) / total)
    drawn = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("s")).where((F.xxhash64("s", F.xxhash64("t")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < share)

    def run(batches):
        for batch in batches:
            data = [x or b"" for x in texts_of(batch, "t")]
            keys = _keys(data, batch.column("s").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(x) + ROW_WEIGHT for x in data], pa.int64())], names=["k", "n"])

    got = drawn.mapInArrow(tidy(run), "k long, n long").toArrow()
    keys, weights = got["k"].to_numpy(), got["n"].to_numpy()
    if not len(keys):
        return np.empty(0, dtype=np.int64)
    order = np.argsort(keys)
    mass = np.cumsum(weights[order])
    at = np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def powers_of_two(n: int) -> list[int]:
    """Descending powers of two that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, ids: bool = True, ranges: int | None = None) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    on request, the ids (32-bit little-endian, binary).

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone.  Every id lies
    in exactly one piece; a sequence's pieces follow each other from offset 0.  Sequences have
    `size` ids (a power of two), or, at the end of a range, a smaller power of two; none needs
    padding.  A repeated row is packed as often as it occurs; a null id is packed as a document
    without id; other columns are left out.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the sequence size must be a power of two")
    bounds = range_bounds(docs, key, text, ranges)
    kind = docs.schema[key].dataType.simpleString()

    def tokenise(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            salts = batch.column("s").to_numpy()
            data = [x or b"" for x in texts_of(batch, "t")]
            for lo, hi in K.chunks(data, 2 << 20):
                keys = _keys(data[lo:hi], salts[lo:hi])
                found = encode([x.decode("utf-8", "replace") for x in data[lo:hi]])
                arrays = [np.append(np.array(x, dtype="<u4"), np.array([end_id], dtype="<u4")) for x in found]
                counts = [len(x) for x in arrays]
                narrow = [(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in arrays]
                part = np.searchsorted(bounds, keys).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(lo, hi - lo), pa.array(part), pa.array(keys), pa.array(counts, pa.int64()), pa.array(narrow, pa.binary())], names=["d", "part", "k", "n", "ids"])

    def packed(batches):
        seq, fill = 0, 0
        part = None
        held: list[tuple] = []  # pieces of the open sequence: (doc, start, ids, doc tokens)
        rows: list[tuple] = []

        def put(pieces, sequence):
            at = 0
            for d, start, x, n in pieces:
                rows.append((d, start, len(x), zlib.crc32(x.tobytes()), n, (part << _RANGE_SHIFT) + sequence, at, x.tobytes() if ids else None))
                at += len(x)

        def close():
            """The open sequence, cut at powers of two."""
            nonlocal seq, fill, held
            for room in powers_of_two(fill):
                taken = []
                while room:
                    d, start, x, n = held[0]
                    taken.append((d, start, x[:room], n))
                    if len(x) > room:
                        held[0] = (d, start + room, x[room:], n)
                        room = 0
                    else:
                        held.pop(0)
                        room -= len(x)
                put(taken, seq)
                seq += 1
            fill, held = 0, []

        def flush():
            nonlocal rows
            columns = list(zip(*rows, strict=True))
            kinds = [id_kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            width = 8 if ids else 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:width], kinds, strict=False)], names=names[:width])

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("d").type
            for d, p, n, blob in zip(batch.column("d").to_pylist(), batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        close()
                    part, seq = p, 0
                x = np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    take = min(size - fill, n - start)
                    held.append((d, start, x[start : start + take], n))
                    fill += take
                    start += take
                    if fill == size:
                        put(held, seq)
                        seq, fill, held = seq + 1, 0, []
                if len(rows) >= 20_000:
                    yield flush()
        if part is not None:
            close()
        if rows:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("s"))
    tokens = rows.mapInArrow(tidy(tokenise), f"d {kind}, part int, k long, n long, ids binary")
    dealt = tokens.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "k", "d", "n")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if ids else "")
    return dealt.mapInArrow(tidy(packed), schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer of that name is installed."""
    if re.search(r"[/\\]", name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))
