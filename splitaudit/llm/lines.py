"""Line dedup by a segment-partition edit join.

A line of l bytes allows tau(l) edits of code points and is cut into tau(l) + 1 segments of code
points; a line within that distance holds one of them unchanged, at a shifted place.  Each line indexes its own
segments under its length and, for each length that a shorter partner may have, probes the
substrings that the multi-match-aware window leaves; a partner of like length may have another tau, which its bytes
bound.  Lines under one key whose code point counts are near enough become members of its group.

A key of more than `HOT` lines (a template's) is not compared as it is: its lines are cut into
`FINE` segments instead, of which two near lines share all but tau, and meet under keys
of all those.  Groups are verified by a banded bit-parallel edit distance, many pairs side by
side: a group is walked in the order of first occurrence, and a line leaves it with the
first earlier line found within its limit.  So what goes out is a row a line, never pairs.

What goes: every occurrence of a line but the first, in the order of key and line; and the
first occurrence of a line that is within tau of another line whose first occurrence is
earlier (tau of the one of fewer bytes).  Lines under `MIN_BYTES` bytes have no near copies, only exact
ones.  All is judged on the input, not on what is left.

Scale: a map task settles its own exact repeats and sends each distinct line once, so a line
that a third of all documents hold is a row a task.  Keys travel as arrays dealt by key; a task
that joins keys gives up those that turn out hot as it reads, so they are never gathered there.
A line has at most about 20 keys, and some 220 more if one of them is hot.  Beyond `blobs.MAX_PARTS` groups
blobs are dealt in two steps and groups stream through bounded partitions.  Documents meet the
lines asked for, and later the lines removed, in shuffles of compressed blocks.  Equal lines are
those of equal 64-bit hash and CRC-32.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs as B
from . import tokens as K
from .common import cut, new_column, shuffle_partitions, texts_of, tidy
from .rowblocks import ROWS, by_key, cut_rows, numbered, read_rows, send_rows

MIN_BYTES = 20
#: Lines of so many bytes on allow one edit, two edits.
ONE_EDIT, TWO_EDITS = 20, 40
MAX_TAU = 2
#: Keys that a group should hold on average.
GROUP_KEYS = 2_000_000
#: Lines under one key from which it is hot, and the segments that its lines are cut into instead.
HOT, FINE = 512, 8
#: Lines of a group that are compared with each other at once; larger groups are walked in blocks.
SMALL, BLOCK = 48, 256
#: Trimmed lines longer than this are compared along diagonals, not in columns.
LONG = 4096
_REMOVED, _FIRST, _OCCUR, _INDEX, _PROBE, _MEMBER, _WANTED = range(7)  # all before rowblocks.ROWS
_HOT = 8


def tau(length: np.ndarray) -> np.ndarray:
    """Edits that a line of so many bytes allows; -1 for a line that has only exact copies."""
    return np.where(length < MIN_BYTES, -1, (length >= ONE_EDIT).astype(np.int64) + (length >= TWO_EDITS))


def _segment(length: np.ndarray, t: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of t + 1; the last ones take the remainder."""
    size, extra = length // (t + 1), length % (t + 1)
    longer = t + 1 - extra  # the first segment with one more byte
    start = i * size + np.maximum(0, i - longer)
    return start, size + (i >= longer)


def _kinds(value: np.ndarray) -> np.ndarray:
    """The class, of eight, of each code point value."""
    return (value * np.uint32(0x9E3779B1) >> np.uint32(29)).astype(np.uint8)


def _nibbles(counts: np.ndarray) -> np.ndarray:
    """Counts (classes, lines) modulo 16, four bits each."""
    out = np.zeros(counts.shape[1], dtype=np.uint32)
    for c, n in enumerate(counts):
        out |= (n & 15).astype(np.uint32) << np.uint32(4 * c)
    return out


def _plus_one(raw: np.ndarray) -> np.ndarray:
    return raw.astype(np.uint64) + np.uint64(1)


class Lines:
    """Lines of some texts, with hashes of any substring."""

    def __init__(self, data: list[bytes]) -> None:
        w = self.words = K.words_of(data, K.NEWLINE)
        self.start, self.length, self.hash = w.start, w.end - w.start, w.hash
        self.doc = np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1
        self.ordinal = np.arange(len(w.start)) - w.first[self.doc]
        buffer = w.raw.tobytes()
        self.check = np.fromiter((zlib.crc32(buffer[a:b]) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)), dtype=np.uint32, count=len(w.start))
        pw, self.inv = K._power_table(len(w.raw) + 1)
        begins = (w.raw & 0xC0) != 0x80
        begins[self.start] = True
        self.place = np.append(np.flatnonzero(begins), len(w.raw))  # first byte of each code point
        count = np.cumsum(begins) - 1
        self.char = count[self.start]
        self.chars = count[w.end] - self.char  # what ends a line is a code point
        self.sums = np.zeros(len(w.raw) + 1, dtype=np.uint64)
        np.cumsum(_plus_one(w.raw) * pw[: len(w.raw)], out=self.sums[1:])

    def _part(self, line: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Polynomial of `size` code points of a line from `at` on."""
        c = self.char[line] + at
        a, b = self.place[c], self.place[c + size]
        return (self.sums[b] - self.sums[a]) * self.inv[a]

    def _key(self, line: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, t: int, i: int) -> np.ndarray:
        return K.mix(self._part(line, at, size) + length.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((t * (MAX_TAU + 1) + i + 1) * 0x2545F4914F6CDD1D & K._MASK))

    def index(self, rows: np.ndarray):
        """(row, key) of the segments that lines index."""
        lengths, edits = self.chars[rows], tau(self.length[rows])
        for t in range(MAX_TAU + 1):
            some = rows[edits == t]
            for i in range(t + 1 if len(some) else 0):
                at, size = _segment(lengths[edits == t], t, i)
                yield some, self._key(some, at, size, self.chars[some], t, i)

    def _partners(self, rows: np.ndarray):
        """(rows, difference in length, the partner's length and tau, whether the rows have that tau) of partners no longer than they."""
        rows = rows[self.length[rows] >= MIN_BYTES]
        own, highest = tau(self.length[rows]), tau(self.length[rows] + 4 * MAX_TAU)
        for less in range(MAX_TAU + 1):
            other = self.chars[rows] - less
            lowest = tau(np.maximum(other, self.length[rows] - 4 * MAX_TAU))
            for t in range(max(1, less), MAX_TAU + 1):
                picked = (lowest <= t) & (t <= highest) & (other > t)
                if picked.any():
                    yield rows[picked], less, other[picked], t, own[picked] == t

    def probes(self, rows: np.ndarray):
        """(row, key) of the substrings at which lines look for partners no longer than they."""
        for some, less, length, t, like in self._partners(rows):
            for i in range(t + 1):
                at, size = _segment(length, t, i)
                for shift in range(max(-i, less - (t - i)), min(i, less + t - i) + 1):
                    place = at + shift
                    ok = (place >= 0) & (place + size <= self.chars[some])
                    if not less and not shift:
                        ok &= ~like  # that is the line's own index key
                    yield some[ok], self._key(some[ok], place[ok], size[ok], length[ok], t, i)

    def _fine(self, line: np.ndarray, length: np.ndarray, less: int, t: int):
        """(rows of `line`, key, whether unshifted) with all but t of a partner's `FINE` segments, wherever these edits may have put them."""
        zero = np.zeros(len(line), dtype=np.int64)
        ends = [_segment(length, FINE - 1, i) for i in range(FINE)]
        for bad in itertools.combinations(range(FINE), t):
            stops = [ends[i] for i in bad]
            base = length.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((sum(b * FINE**k for k, b in enumerate(bad)) * 4 + t) * 0x8CB92BA72F3D8DD7 & K._MASK)
            head = self._part(line, zero, stops[0][0])
            after = stops[-1][0] + stops[-1][1]
            tail = self._part(line, after + less, length - after)
            ends_key = base + head * np.uint64(0x9FB21C651E98DF25) + tail * np.uint64(0xA24BAED4963EE407)
            if t == 1:
                yield np.arange(len(line)), K.mix(ends_key), less == 0
                continue
            (a, na), (b, nb) = stops
            size = b - a - na
            for shift in range(less - t, t + 1):
                if abs(shift) + abs(less - shift) > t:
                    continue
                ok = np.flatnonzero(((size > 0) & (na + shift >= 0) & (nb + less - shift >= 0)) | ((size == 0) & (shift == 0)))
                middle = self._part(line[ok], np.where(size[ok] > 0, a[ok] + na[ok] + shift, 0), size[ok])
                yield ok, K.mix(ends_key[ok] + middle * np.uint64(0xD6E8FEB86659FD93)), less == 0 and shift == 0

    def fine_index(self, rows: np.ndarray):
        edits = tau(self.length[rows])
        for t in range(1, MAX_TAU + 1):
            some = rows[edits == t]
            if len(some):
                for at, key, unshifted in self._fine(some, self.chars[some], 0, t):
                    if unshifted:
                        yield some[at], key

    def fine_probes(self, rows: np.ndarray):
        for some, less, length, t, like in self._partners(rows):
            for at, key, unshifted in self._fine(some, length, less, t):
                if unshifted:
                    at, key = at[~like[at]], key[~like[at]]
                yield some[at], key

    def sketches(self, rows: np.ndarray) -> np.ndarray:
        """Counts of eight code point classes modulo 16, four bits each."""
        raw, at = self.words.raw, self.place[:-1]
        value = raw[at].astype(np.uint32)
        wide = np.flatnonzero(value >= 0x80)
        for k in range(1, 4):
            wide = wide[self.place[wide + 1] - at[wide] > k]
            value[wide] = value[wide] * np.uint32(31) + raw[at[wide] + k]
        kinds = _kinds(value)
        counts = np.empty((8, len(rows)), dtype=np.int64)
        for c in range(8):
            total = np.zeros(len(kinds) + 1, dtype=np.int32)
            np.cumsum(kinds == c, out=total[1:])
            counts[c] = total[self.char[rows] + self.chars[rows]] - total[self.char[rows]]
        return _nibbles(counts)


class LongLine(Lines):
    """One line that is longer than a chunk, with the same keys, read a piece at a time."""

    def __init__(self, line: bytes) -> None:
        self.raw = np.frombuffer(line, dtype=np.uint8)
        w = K.words_of([line], K.NEWLINE)
        self.hash, self.check = w.hash, np.array([zlib.crc32(line)], dtype=np.uint32)
        self.length, self.doc, self.ordinal = np.array([len(line)]), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.before = np.cumsum([0] + [int(((x & 0xC0) != 0x80).sum()) for x in self._pieces()])
        self.chars = self.before[-1:]

    def _pieces(self):
        return (self.raw[lo : lo + K.CHUNK_BYTES] for lo in range(0, len(self.raw), K.CHUNK_BYTES))

    def _byte(self, char: int) -> int:
        """First byte of a code point."""
        k = int(np.searchsorted(self.before, char, side="right")) - 1
        if k >= len(self.before) - 1:
            return len(self.raw)
        lo = k * K.CHUNK_BYTES
        return lo + int(np.flatnonzero((self.raw[lo : lo + K.CHUNK_BYTES] & 0xC0) != 0x80)[char - int(self.before[k])])

    def _part(self, line: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.array([K.poly_hash(self.raw[self._byte(a) : self._byte(a + n)], _plus_one) for a, n in zip(at.tolist(), size.tolist(), strict=True)], dtype=np.uint64)

    def sketches(self, rows: np.ndarray) -> np.ndarray:
        counts = np.zeros(8, dtype=np.int64)
        for lo in range(0, len(self.raw), K.CHUNK_BYTES):
            part = self.raw[lo : lo + K.CHUNK_BYTES + 3]
            at = np.flatnonzero((part[: K.CHUNK_BYTES] & 0xC0) != 0x80)
            value = part[at].astype(np.uint32)
            wide = np.flatnonzero(value >= 0x80)
            for k in range(1, 4):
                inside = at[wide] + k < len(part)
                wide = wide[inside]
                wide = wide[(part[at[wide] + k] & 0xC0) == 0x80]
                value[wide] = value[wide] * np.uint32(31) + part[at[wide] + k]
            counts += np.bincount(_kinds(value), minlength=8)
        return _nibbles(counts[:, None])[np.zeros(len(rows), dtype=int)]


def lines_of(data: list[bytes]):
    """`Lines` of some texts, with each one's document and ordinal there; long texts are taken in slices."""
    for lo, hi in K.chunks(data):
        if len(data[lo]) <= K.CHUNK_BYTES:
            x = Lines(data[lo:hi])
            x.doc += lo
            yield x
            continue
        done = 0
        for part in K.slices(data[lo], K.NEWLINE):
            one = part.rstrip(b"\n")
            x = LongLine(one) if len(one) > K.CHUNK_BYTES else Lines([part])
            x.doc += lo
            x.ordinal += done
            done += len(x.hash)
            yield x


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of twice the edit distance from two sketches."""
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.uint8)
    for c in range(8):
        d = ((a >> np.uint32(4 * c)) - (b >> np.uint32(4 * c))) & np.uint32(15)
        total += np.minimum(d, np.uint32(16) - d).astype(np.uint8)
    return total


def within(a: list, b: list, limit: int) -> np.ndarray:
    """Whether each pair's edit distance, of bytes or of a str's code points, is at most `limit` (0 to 20), by banded bit-parallel columns.

    The band's cells of a column are the bits of a word; all pairs take a column at a time.
    """
    out = np.zeros(len(a), dtype=bool)
    rows, short, long = [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if len(y) - len(x) > limit:
            continue
        n = _common(x, y)
        m = _common(x[n:][::-1], y[n:][::-1])
        x, y = x[n : len(x) - m], y[n : len(y) - m]
        if not x or not limit:
            out[k] = len(y) <= limit
            continue
        if len(y) > LONG:
            out[k] = _along(x, y, limit)
            continue
        rows.append(k)
        short.append(x)
        long.append(y)
    order = sorted(range(len(rows)), key=lambda k: len(long[k]))
    lo = 0
    while lo < len(order):  # pairs of like length, in blocks of bounded bytes
        hi = lo + 1
        while hi < len(order) and hi - lo < 4096 and (hi + 1 - lo) * (len(long[order[hi]]) + 64) <= 16 << 20:
            hi += 1
        some = order[lo:hi]
        out[[rows[k] for k in some]] = _banded([short[k] for k in some], [long[k] for k in some], limit)
        lo = hi
    return out


def _along(x: bytes | str, y: bytes | str, limit: int) -> bool:
    """Whether the distance is at most `limit`, by the furthest place that e edits reach on each diagonal."""
    reach = {0: _common(x, y)}
    for _ in range(limit):
        more = {}
        for d in range(min(reach) - 1, max(reach) + 2):
            row = max(reach[d] + 1 if d in reach else -1, reach[d - 1] if d - 1 in reach else -1, reach[d + 1] + 1 if d + 1 in reach else -1)
            row = min(row, len(x), len(y) - d)
            if row >= 0 and row + d >= 0:
                more[d] = row + _common(x[row:], y[row + d :])
        reach = more
    d = len(y) - len(x)
    return reach.get(d, -1) >= len(x)


def _common(x: bytes | str, y: bytes | str) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 16:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    while x[lo] == y[lo]:
        lo += 1
    return lo


def _banded(short: list, long: list, limit: int) -> np.ndarray:
    """Pattern: the long texts; text: the short ones.  Bit k of a column j is row j + k - limit."""
    width = 2 * limit + 1
    word = np.uint64((1 << width) - 1)
    n_long = np.array([len(x) for x in long])
    n_short = np.array([len(x) for x in short])
    top = int(n_long.max())
    kind = np.int32 if isinstance(long[0], str) else np.int16
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") if isinstance(x, str) else np.frombuffer(x, dtype=np.uint8)
    pattern = np.zeros((len(long), top + 2 * width), dtype=kind)
    pattern[:] = -1
    text = np.full((len(short), int(n_short.max())), -2, dtype=kind)
    for k, (x, y) in enumerate(zip(short, long, strict=True)):
        pattern[k, limit : limit + len(y)] = codes(y)  # row r is at r + limit
        text[k, : len(x)] = codes(x)
    one = np.uint64(1)
    # before the first column rows 0..limit hold 0..limit: rises at rows 1..limit, none above
    vp = np.full(len(long), ((1 << limit) - 1) << (limit + 1), dtype=np.uint64) >> one
    vp |= np.uint64(1 << (width - 1))
    vn = np.zeros(len(long), dtype=np.uint64)
    low = np.full(len(long), limit, dtype=np.int64)  # value on the band's lowest diagonal
    result = np.full(len(long), limit + 1, dtype=np.int64)
    for j in range(int(n_short.max())):
        match = np.zeros(len(long), dtype=np.uint64)
        for k in range(width):
            match |= (pattern[:, j + k] == text[:, j]).astype(np.uint64) << np.uint64(k)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & word
        hp = (vn | ~(d0 | vp)) & word
        hn = d0 & vp
        low += 1 - ((d0 >> np.uint64(width - 1)) & one).astype(np.int64)
        vp = (hn | ~((d0 >> one) | hp)) & word
        vn = (d0 >> one) & hp
        ended = np.flatnonzero(n_short == j + 1)
        if len(ended):  # walk up from the lowest diagonal to the pattern's last row
            value = low[ended].copy()
            for k in range(width - 1, -1, -1):
                row = j + 1 + k - limit  # rows counted from 1
                above = row > n_long[ended]
                # the vertical difference between row and row - 1 is held shifted by one
                rise = ((vp[ended] >> np.uint64(k - 1)) & one).astype(np.int64) - ((vn[ended] >> np.uint64(k - 1)) & one).astype(np.int64) if k else 0
                value = np.where(above, value - rise, value)
            result[ended] = value
    return result <= limit


def _by(h: np.ndarray, groups: int) -> np.ndarray:
    return (h.astype(np.uint64) % np.uint64(groups)).astype(np.int32)


def _groups(docs: DataFrame, text: str) -> int:
    """Groups that hold about `GROUP_KEYS` each."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return B.whole_groups(max(shuffle_partitions(docs.sparkSession), int(size / 400 * 12 / GROUP_KEYS) + 1))


def _send_removed(sender: B.Sender, ids: np.ndarray, crcs: np.ndarray, ordinals: np.ndarray, parts: int) -> None:
    for part, at in B.split_by(by_key(ids, parts), parts):
        sender.add(part, _REMOVED, B.pack(ids[at], crcs[at], B.narrow(ordinals[at]).astype(np.uint32)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: str | None = None) -> DataFrame:
    """`docs` with their texts less the duplicate lines; `counts` names an extra struct (lines, removed).

    Lines are what line feeds separate; empty ones are no lines and stay.  A removed line goes
    with its line feed.  A null text stays null; a text all of whose lines go becomes what is left
    between them.  Every row stays.  Null keys come last in the order; rows that repeat key and
    text are one document given several times and lose the same lines.  An empty table gives an
    empty result; other columns stay as they are (one named like `counts` is an error).
    """
    counts = counts and new_column(docs, counts, counts)
    groups = _groups(docs, text)
    rows, number = numbered(docs, key)
    slim = rows.select(F.col(number).alias("d"), F.col(text).alias("t"))
    seen = cut(_joined(slim.mapInArrow(tidy(_scan(B.dealt_to(groups))), B.SCHEMA), groups, HOT), "line-keys")
    losers = _near_losers(slim, seen, groups)
    removed = seen.where(F.col("kind") == _REMOVED).select("part", "kind", "blob").union(losers)
    return _settle(rows, removed, number, text, groups, counts)


def _send_keys(sender: B.Sender, x: Lines, once: np.ndarray, index, probes, parts: int) -> None:
    sketch = np.zeros(len(x.hash), dtype=np.uint32)
    sketch[once] = x.sketches(once)
    for kind, found in ((_INDEX, list(index)), (_PROBE, list(probes))):
        if found:
            line, keys = (np.concatenate([f[i] for f in found]) for i in range(2))
            for part, at in B.split_by(_by(keys, parts), parts):
                sender.add(part, kind, B.pack(keys[at], x.hash[line[at]], sketch[line[at]]))


def _scan(parts: int):
    """Blobs of repeats within a task, first occurrences, and keys."""

    def scan(batches):
        sender = B.Sender()
        for batch in batches:
            ids, data = batch.column("d").to_numpy(), [x or b"" for x in texts_of(batch, "t")]
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], [data[i] for i in order]
            crcs = np.array([zlib.crc32(x) for x in data], dtype=np.uint32)
            for x in lines_of(data):
                by_hash = np.lexsort((x.check, x.hash))
                again = np.zeros(len(by_hash), dtype=bool)
                again[1:] = (x.hash[by_hash[1:]] == x.hash[by_hash[:-1]]) & (x.check[by_hash[1:]] == x.check[by_hash[:-1]])
                lead = by_hash[np.maximum.accumulate(np.where(again, 0, np.arange(len(by_hash))))] if len(by_hash) else by_hash
                same, first = by_hash[again], lead[again]
                real = (ids[x.doc[same]] != ids[x.doc[first]]) | (x.ordinal[same] != x.ordinal[first])
                same = np.sort(same[real])
                _send_removed(sender, ids[x.doc[same]], crcs[x.doc[same]], x.ordinal[same], parts)
                once = np.sort(by_hash[~again])
                for part, at in B.split_by(_by(x.hash[once], parts), parts):
                    at = once[at]
                    sender.add(part, _OCCUR, B.pack(x.hash[at], x.check[at], ids[x.doc[at]], crcs[x.doc[at]], B.narrow(x.ordinal[at]).astype(np.uint32)))
                _send_keys(sender, x, once, x.index(once), x.probes(once), parts)
                yield from sender.full()
        yield from sender.rest()

    return scan


class _Keys:
    """Keys of lines as they come in; those of more than `hot` lines are given up."""

    def __init__(self, hot: int | None) -> None:
        self.hot = hot
        self.given_up = np.empty(0, dtype=np.uint64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit = 0, 2 * GROUP_KEYS

    def add(self, indexed: bool, key: np.ndarray, unit: np.ndarray, sketch: np.ndarray):
        """Units of hot keys that came to light."""
        if len(self.given_up):
            at = np.minimum(np.searchsorted(self.given_up, key), len(self.given_up) - 1)
            hot = self.given_up[at] == key
            if hot.any():
                yield unit[hot]
                key, unit, sketch = key[~hot], unit[~hot], sketch[~hot]
        self.held.append((key, unit, np.full(len(key), indexed), sketch))
        self.size += len(key)
        if self.size > self.limit:
            yield from self.settle()
            self.limit = max(self.limit, 2 * self.size)

    def settle(self):
        """Sort what is held by key and unit, once each, and give up hot keys."""
        if not self.held:
            return
        key, unit, indexed, sketch = (np.concatenate([h[i] for h in self.held]) for i in range(4))
        order = np.lexsort((~indexed, unit, key))
        k, u = key[order], unit[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (u[1:] != u[:-1])  # an indexed one stands for a probe
        order = order[new]
        key, unit, indexed, sketch = key[order], unit[order], indexed[order], sketch[order]
        if self.hot:
            edges = np.append(np.flatnonzero(np.diff(key, prepend=~key[:1])), len(key))
            wide = np.flatnonzero(np.diff(edges) > self.hot)
            if len(wide):
                out = np.zeros(len(key), dtype=bool)
                for a, b in zip(edges[wide].tolist(), edges[wide + 1].tolist(), strict=True):
                    out[a:b] = True
                yield unit[out]
                self.given_up = np.union1d(self.given_up, key[edges[wide]])
                key, unit, indexed, sketch = key[~out], unit[~out], indexed[~out], sketch[~out]
        self.held = [(key, unit, indexed, sketch)]
        self.size = len(key)

    def members(self):
        """(key, unit, indexed, sketch) of lines that have a possible partner under a key; call after settle."""
        if not self.held:
            return None
        key, unit, indexed, sketch = self.held[0]
        edges = np.append(np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.empty(0, dtype=int), len(key))
        size = np.repeat(np.diff(edges), np.diff(edges))
        keep = size > SMALL
        for s in range(1, SMALL):
            at = np.flatnonzero(size[: len(key) - s] > s) if s < len(key) else np.empty(0, dtype=int)
            at = at[(size[at] <= SMALL) & (key[at + s] == key[at])]
            if not len(at):
                break
            at = at[(indexed[at] | indexed[at + s]) & (_apart(sketch[at], sketch[at + s]) <= 2 * MAX_TAU)]
            keep[at] = keep[at + s] = True
        return key[keep], unit[keep], indexed[keep].astype(np.uint8), sketch[keep]


def _joined(sent: DataFrame, groups: int, hot: int | None) -> DataFrame:
    """Blobs of removed repeats, first occurrences, members of keys and, apart from them, units of hot keys."""
    parts = B.dealt_to(groups)

    def join_keys(batches):
        sender = B.Sender()
        occur, keys = [], _Keys(hot)

        def tell(units):
            for u in units:
                sender.add(0, _HOT, B.pack(np.unique(u)))

        for batch in batches:
            for part, k, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _REMOVED:
                    sender.add(part, k, blob)
                elif k == _OCCUR:
                    occur.append(B.unpack(blob))
                else:
                    tell(keys.add(k == _INDEX, *B.unpack(blob)))
            yield from sender.full()
        if occur:
            unit, check, ids, crcs, ordinals = (np.concatenate([o[i] for o in occur]) for i in range(5))
            occur.clear()
            order = np.lexsort((ordinals, ids, check, unit))
            unit, check, ids, crcs, ordinals = unit[order], check[order], ids[order], crcs[order], ordinals[order]
            new = np.ones(len(unit), dtype=bool)
            new[1:] = (unit[1:] != unit[:-1]) | (check[1:] != check[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(unit)), 0))
            later = (ids != ids[lead]) | (ordinals != ordinals[lead])
            _send_removed(sender, ids[later], crcs[later], ordinals[later], parts)
            for part, at in B.split_by(_by(unit[new], parts), parts):
                at = np.flatnonzero(new)[at]
                sender.add(part, _FIRST, B.pack(unit[at], ids[at], crcs[at], ordinals[at]))
            yield from sender.full()
        tell(keys.settle())
        found = keys.members()
        if found:
            for lo in range(0, len(found[0]), 1 << 16):
                sender.add(0, _MEMBER, B.pack(*(x[lo : lo + (1 << 16)] for x in found)))
                yield from sender.full()
        yield from sender.rest()

    return B.by_group(sent, groups, join_keys, B.SCHEMA, {k: B.cut_by(0) for k in (_OCCUR, _INDEX, _PROBE)})


def _exploded(seen: DataFrame, kind: int, names: list[str]) -> DataFrame:
    """The arrays of one kind of blobs as long columns."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                columns = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in B.unpack(blob)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return seen.where(F.col("kind") == kind).select("blob").mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def _near_losers(slim: DataFrame, seen: DataFrame, groups: int) -> DataFrame:
    """Blobs of the first occurrences that go because a line within tau comes first."""
    parts = B.dealt_to(groups)
    members, hot = _exploded(seen, _MEMBER, ["k", "u", "ix", "sk"]), _exploded(seen, _HOT, ["u"])
    wanted = members.select("u", F.lit(False).alias("hot")).union(hot.select("u", F.lit(True).alias("hot"))).groupBy("u").agg(F.max("hot").alias("hot"))
    first = _exploded(seen, _FIRST, ["u", "d", "crc", "line"])
    contents = cut(_contents(slim, wanted.join(first, "u"), groups), "lines")

    def fine_keys(batches):
        sender = B.Sender()
        for batch in batches:
            units, data = batch.column("u").to_numpy().view(np.uint64), batch.column("bytes").to_pylist()
            for lo, hi in K.chunks(data, 1 << 18):
                for x in lines_of(data[lo:hi]):
                    every = np.arange(len(x.hash))
                    assert (x.hash == units[lo + x.doc]).all()
                    _send_keys(sender, x, every, x.fine_index(every), x.fine_probes(every), parts)
                    yield from sender.full()
        yield from sender.rest()

    if hot.limit(1).count():
        finer = _joined(contents.where("hot").select("u", "bytes").mapInArrow(tidy(fine_keys), B.SCHEMA), groups, None)
        members = members.union(_exploded(cut(finer, "fine-keys"), _MEMBER, ["k", "u", "ix", "sk"]))

    def verify(batches):
        sender = B.Sender()
        walk = _Walk()
        for batch in batches:
            lost = walk.add(batch)
            if len(lost[0]):
                _send_removed(sender, *lost, parts)
            yield from sender.full()
        lost = walk.end()
        if len(lost[0]):
            _send_removed(sender, *lost, parts)
        yield from sender.rest()

    met = members.join(contents.drop("hot"), "u").select("k", "ix", "sk", "d", "crc", "line", "bytes")
    return met.repartition("k").sortWithinPartitions("k", "d", "line").mapInArrow(tidy(verify), B.SCHEMA)


def _contents(slim: DataFrame, wanted: DataFrame, groups: int) -> DataFrame:
    """(u, hot, d, crc, line, bytes) of the lines asked for."""
    parts = B.dealt_to(groups)

    def send_wanted(batches):
        sender = B.Sender()
        for batch in batches:
            u, hot, d, crc, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "hot", "d", "crc", "line"))
            for part, at in B.split_by(by_key(d, parts), parts):
                sender.add(part, _WANTED, B.pack(u[at], hot[at].astype(np.uint8), d[at], crc[at], line[at]))
            yield from sender.full()
        yield from sender.rest()

    def fetch(batches):
        wanted: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for k, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _WANTED:
                    for u, hot, d, crc, line in zip(*(x.tolist() for x in B.unpack(blob)), strict=True):
                        wanted.setdefault((d, crc), []).append((line, u, hot))
                    continue
                out = []
                docs = read_rows(blob)
                for d, data in zip(docs.column(0).to_pylist(), docs.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    crc = zlib.crc32(data or b"")
                    asked = wanted.pop((d, crc), None)
                    if asked:
                        lines = [x for x in data.split(b"\n") if x]
                        out += [(u, bool(hot), d, crc, line, lines[line]) for line, u, hot in asked]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["u", "hot", "d", "crc", "line", "bytes"])

    met = wanted.select("u", "hot", "d", "crc", "line").mapInArrow(tidy(send_wanted), B.SCHEMA).union(send_rows(slim, "d", parts))
    return B.by_group(met, groups, fetch, "u long, hot boolean, d long, crc long, line long, bytes binary", {_WANTED: B.cut_by(2, K.mix), ROWS: cut_rows("d")}, ordered=True)


def _near(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether each pair of lines is within the tau of the one of fewer bytes."""
    near = np.zeros(len(a), dtype=bool)
    if not a:
        return near
    limit = tau(np.minimum([len(x) for x in a], [len(x) for x in b]))
    plain = np.array([x.isascii() and y.isascii() for x, y in zip(a, b, strict=True)], dtype=bool)
    for t in range(1, MAX_TAU + 1):
        for ascii_, read in ((True, lambda x: x), (False, lambda x: x.decode("utf-8", "surrogateescape"))):
            some = np.flatnonzero((limit == t) & (plain == ascii_))
            if len(some):
                near[some] = within([read(a[i]) for i in some], [read(b[i]) for i in some], t)
    return near


class _Walk:
    """Groups of lines under one key, in the order of first occurrence: who has an earlier line within tau."""

    def __init__(self) -> None:
        self.kept: list[bytes] = []
        self.open = {c: np.empty(0, dtype=np.int64) for c in ("k", "ix", "sk", "d", "crc", "line")}
        self.lost = np.empty(0, dtype=bool)
        self.done = 0  # rows of the open group that have been walked

    def add(self, batch: pa.RecordBatch):
        self.kept += batch.column("bytes").to_pylist()
        for c in self.open:
            self.open[c] = np.concatenate([self.open[c], batch.column(c).to_numpy()])
        k = self.open["k"]
        self.lost = np.append(self.lost, np.zeros(len(k) - len(self.lost), dtype=bool))
        edges = np.append(np.flatnonzero(np.diff(k, prepend=~k[:1])), len(k))
        last = int(edges[-2]) if len(k) else 0  # the last group may go on
        if len(k) - last - (self.done if not last else 0) >= 4 * BLOCK:
            self._block(last + (self.done if not last else 0), len(k), last)
            walked = len(k) - last
        else:
            walked = self.done if not last else 0
        return self._close(edges[:-1], last, walked)

    def end(self):
        k = self.open["k"]
        edges = np.append(np.flatnonzero(np.diff(k, prepend=~k[:1])), len(k))
        return self._close(edges, len(k), 0)

    def _close(self, edges: np.ndarray, last: int, walked: int):
        """Settle the groups before `last` and drop them: (d, crc, line) of those who lost."""
        sizes = np.diff(edges)
        size = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes)
        end = np.repeat(edges[1:], sizes)
        for s in range(1, SMALL):  # from the nearest earlier line outwards; those who have lost are asked no more
            at = np.flatnonzero(size > s)
            at = at[at + s < end[at]]
            if not len(at):
                break
            self._ask(at[~self.lost[at + s]], s)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            begin = self.done if not g else 0
            self._block(int(edges[g]) + begin, int(edges[g + 1]), int(edges[g]))
        lost = np.flatnonzero(self.lost[:last])
        out = tuple(self.open[c][lost] for c in ("d", "crc", "line"))
        if last:
            self.kept = self.kept[last:]
            self.lost = self.lost[last:]
            for c in self.open:
                self.open[c] = self.open[c][last:]
        self.done = walked
        return out[0], out[1].astype(np.uint32), out[2]

    def _ask(self, earlier: np.ndarray, s: int) -> None:
        later = earlier + s
        o = self.open
        ok = (o["ix"][earlier] | o["ix"][later]).astype(bool) & ((o["d"][earlier] < o["d"][later]) | (o["line"][earlier] < o["line"][later]))
        earlier, later = earlier[ok], later[ok]
        ok = _apart(o["sk"][earlier].astype(np.uint32), o["sk"][later].astype(np.uint32)) <= 2 * MAX_TAU
        earlier, later = earlier[ok], later[ok]
        near = _near([self.kept[i] for i in earlier.tolist()], [self.kept[i] for i in later.tolist()])
        self.lost[later[near]] = True

    def _block(self, lo: int, hi: int, begin: int) -> None:
        """Ask the rows lo..hi of the group that begins at `begin` after all that are earlier, a block at a time."""
        o = self.open
        sk = o["sk"][begin:hi].astype(np.uint32)
        for first in range(begin, hi, BLOCK):
            stop = min(first + BLOCK, hi)
            asked = np.arange(max(lo, first + 1), hi)
            for at in range(0, len(asked), 4096):
                later = asked[at : at + 4096]
                later = later[~self.lost[later]]
                early = np.arange(first, stop)
                able = (o["ix"][later][:, None] | o["ix"][early][None, :]).astype(bool) & (early[None, :] < later[:, None])
                able &= (o["d"][early][None, :] < o["d"][later][:, None]) | (o["line"][early][None, :] < o["line"][later][:, None])
                able &= _apart(sk[later - begin][:, None], sk[early - begin][None, :]) <= 2 * MAX_TAU
                take = 1
                while able.any():
                    rank = np.cumsum(able, axis=1)
                    r, c = np.nonzero(able & (rank <= take))
                    near = _near([self.kept[early[i]] for i in c.tolist()], [self.kept[later[i]] for i in r.tolist()])
                    self.lost[later[r[near]]] = True
                    able &= rank > take
                    left = ~self.lost[later]
                    later, able = later[left], able[left]
                    take *= 2


def _settle(rows: DataFrame, removed: DataFrame, number: str, text: str, groups: int, counts: str | None) -> DataFrame:
    names = [c for c in rows.columns if c != number]
    schema = T.StructType([f for f in rows.schema.fields if f.name != number])
    if counts:
        kind = T.StructType([T.StructField("lines", T.LongType()), T.StructField("removed", T.LongType())])
        schema = T.StructType([*schema.fields, T.StructField(counts, kind)])

    def run(batches):
        gone: dict[tuple[int, int], set[int]] = {}
        for batch in batches:
            for k, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k == _REMOVED:
                    for d, crc, line in zip(*(x.tolist() for x in B.unpack(blob)), strict=True):
                        gone.setdefault((d, crc), set()).add(line)
                    continue
                table = read_rows(blob)
                new, lines, removed_ = [], [], []
                for d, data in zip(table.column(number).to_pylist(), table.column(text).cast(pa.binary()).to_pylist(), strict=True):
                    drop = gone.get((d, zlib.crc32(data or b"")), ())
                    kept, n = [], 0
                    for x in (data or b"").split(b"\n"):
                        if x:
                            n += 1
                        if not x or n - 1 not in drop:
                            kept.append(x)
                    new.append(data if not drop else b"\n".join(kept))
                    lines.append(n)
                    removed_.append(len(drop))
                columns = [pa.array(new, pa.binary()).cast(pa.string()) if c == text else table.column(c).combine_chunks() for c in names]
                out = [*names]
                if counts:
                    columns.append(pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(removed_, pa.int64())], names=["lines", "removed"]))
                    out.append(counts)
                yield pa.RecordBatch.from_arrays(columns, names=out)

    both = removed.union(send_rows(rows, number, B.dealt_to(groups)))
    return B.by_group(both, groups, run, schema, {_REMOVED: B.cut_by(0, K.mix), ROWS: cut_rows(number)}, ordered=True)
