"""Vectorised word kernels: one numpy pass over the UTF-8 bytes of a batch of texts.

A batch of texts becomes one byte buffer in which texts are separated by a
non-word byte.  Word borders, word hashes and shingle hashes are then array
expressions over that buffer, so no Python object is made for a word.

Word hashes are 64-bit: a polynomial over the bytes, taken from one prefix sum
(the base is odd, so its powers have inverses modulo 2**64), then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE2 = 0xD6E8FEB86659FD93
#: Bytes of text that one kernel call works on; larger batches are cut into several calls.
CHUNK_BYTES = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, kept for reuse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = -(-n // (1 << 18)) << 18
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                t[done : done + more] = t[:more] * np.uint64(pow(b, done, 1 << 64))
                done += more
            tables.append(t)
        have = _powers[base] = (tables[0], tables[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _table(separators: bytes | None, lower: bool) -> np.ndarray:
    """Byte map to 0 for a separator, else to the byte itself (A-Z lowered on request)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if separators is None:  # letters a-z, digits and all that is not ASCII
        keep = np.zeros(256, dtype=bool)
        keep[48:58] = keep[97:123] = True
        keep[128:] = True
        t[~keep[t]] = 0
    else:
        t[list(separators)] = 0
    return t


#: `[^\x20\x09-\x0D]+`: words between ASCII white space.
SPACE = _table(b" \t\n\x0b\x0c\r", False)
SPACE_LOWER = _table(b" \t\n\x0b\x0c\r", True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lowering A-Z.
ALNUM_LOWER = _table(None, True)
#: Lines: only the line feed separates.
NEWLINE = _table(b"\n", False)


@dataclass
class Words:
    """Words of several texts: byte borders in `raw`, hashes, and each text's first word."""

    raw: np.ndarray  # the bytes as written
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # len(texts) + 1 offsets into the words


def _values(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash values of bytes; 0 for separators.

    Where the table keeps NUL as a word byte (white-space tables do), it is moved
    to a value of its own so that it differs from the separator.
    """
    val = table[raw].astype(np.uint16)
    if table[1] == 1:  # white-space table: NUL is a word byte
        np.putmask(val, raw == 0, 256)
    return val


def poly_hash(raw: np.ndarray, values) -> int:
    """The polynomial over `values(bytes)` of one long byte string, a piece at a time."""
    total = 0
    for lo in range(0, len(raw), CHUNK_BYTES):
        val = values(raw[lo : lo + CHUNK_BYTES]).astype(np.uint64)
        pw, _ = _power_table(len(val))
        total += int((val * pw).sum(dtype=np.uint64)) * pow(_BASE, lo, 1 << 64)
    return total & _MASK


def words_of(texts: list[bytes], table: np.ndarray, hashed: bool = True) -> Words:
    """Words of each text under a byte table.

    The buffer is taken in pieces that end at separators, so that what is held beside it grows
    with its words, not with its bytes; a word longer than a piece is hashed by itself.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(raw):
        stop = min(at + CHUNK_BYTES, len(raw))
        val = _values(raw[at:stop], table)
        if stop < len(raw):
            gaps = np.flatnonzero(val == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                val = val[: stop - at]
            else:  # one word from here on
                while (val := _values(raw[stop : stop + CHUNK_BYTES], table)).all():
                    stop += CHUNK_BYTES
                stop += int(np.argmin(val != 0))
                starts.append(np.array([at]))
                ends.append(np.array([stop]))
                if hashed:
                    hashes.append(np.array([poly_hash(raw[at:stop], lambda x: _values(x, table))], dtype=np.uint64))
                at = stop
                continue
        edges = np.flatnonzero(np.diff((val != 0).view(np.int8), prepend=np.int8(0)))
        start, end = edges[0::2], edges[1::2]
        if hashed:
            pw, inv = _power_table(len(val) + 1)
            sums = np.zeros(len(val) + 1, dtype=np.uint64)
            np.cumsum(val.astype(np.uint64) * pw[: len(val)], out=sums[1:])
            hashes.append((sums[end] - sums[start]) * inv[start])
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    start, end = (x[0] if len(x) == 1 else np.concatenate(x) for x in (starts, ends))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_start = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=text_start[1:])
    first = np.searchsorted(start, text_start)
    h = np.empty(0, dtype=np.uint64)
    if hashed:
        h = mix((hashes[0] if len(hashes) == 1 else np.concatenate(hashes)) + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return Words(raw, start, end, h, first)


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(lo, hi) ranges of at most `limit` bytes each, or of one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def slices(text: bytes, table: np.ndarray, limit: int | None = None):
    """A long text in parts of about `limit` bytes that end at separators (or hold one longer word)."""
    limit = limit or CHUNK_BYTES
    at = 0
    while len(text) - at > limit:
        stop = at + limit
        gaps = np.flatnonzero(_values(np.frombuffer(text, dtype=np.uint8, count=limit, offset=at), table) == 0)
        if len(gaps):
            stop = at + int(gaps[-1]) + 1
        else:
            while stop < len(text):
                gaps = np.flatnonzero(_values(np.frombuffer(text, dtype=np.uint8, count=min(limit, len(text) - stop), offset=stop), table) == 0)
                if len(gaps):
                    stop += int(gaps[0]) + 1
                    break
                stop = min(stop + limit, len(text))
        yield text[at:stop]
        at = stop
    if at < len(text) or not text:
        yield text[at:]


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive word hashes; position i covers words i..i+n-1."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(h) - n + 1, seed * 2 + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE2)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def set_hash(h: np.ndarray, seed: int) -> int:
    """One hash of a sequence of hashes."""
    if not len(h):
        return 0
    pw, _ = _power_table(len(h) + 1, _BASE2)
    s = int((h * pw[1 : len(h) + 1]).sum(dtype=np.uint64)) + seed + len(h) * 0x632BE59BD9B4E019
    return int(mix(np.array([s & _MASK], dtype=np.uint64))[0])


def shingle_sets(texts, n: int = 5, table: np.ndarray = SPACE_LOWER):
    """Sorted distinct n-word shingle hashes of each text.

    A text of fewer words than n, but some, has its whole word sequence as its one
    shingle; a null text or one without words has none.
    """
    yield from shingle_sets_of(encode(texts), n, table)


def shingle_sets_of(data: list[bytes], n: int = 5, table: np.ndarray = SPACE_LOWER):
    """`shingle_sets` of texts that are UTF-8 bytes already."""
    for lo, hi in chunks(data):
        w = words_of(data[lo:hi], table)
        grams = gram_hashes(w.hash, n)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hashes(w.hash[a:b], b - a, seed=b - a)
            else:
                yield np.empty(0, dtype=np.uint64)
