"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, window=13):
    """{doc: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = {}
    for item, text in items:
        words = ALNUM.findall(low(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).update({str(item)} if item is not None else ())
    out = {}
    for doc, text in docs:
        words, hit, found = ALNUM.findall(low(text)), set(), set()
        for n, known in windows.items():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in known:
                    found |= known[tuple(words[i : i + n])]
                    hit.update(range(i, i + n))
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words))
    return out


def union(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n=5):
    words = WHITE.findall(low(text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def jaccard(docs):
    """{doc: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comps = union(links, ids)
    return {d: (len(sets[d]), comps[d]) for d in ids}


def repeats(docs, window=20):
    """{doc: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        words = WHITE.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_dedup(docs):
    """{doc: (n_lines, n_removed, kept text)}: exact repeats of any length; edits of code points, limits by UTF-8 bytes."""
    first = {}
    docs = sorted(docs, key=lambda r: r[0])
    for doc, text in docs:
        for k, x in enumerate(x for x in (text or "").split("\n") if x):
            first.setdefault(x, (doc, k))
    size = {x: len(x.encode()) for x in first}
    tau = lambda n: 2 if n >= 40 else 1
    lines = sorted((x for x in first if size[x] >= 20), key=len)
    lose = set()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > 2:
                break
            t = tau(min(size[a], size[b]))
            if len(b) - len(a) <= t and edits(a, b) <= t:
                lose.add(max(a, b, key=first.get))
    out = {}
    for doc, text in docs:
        kept, k, gone = [], 0, 0
        for x in (text or "").split("\n"):
            if x:
                k += 1
                if first[x] != (doc, k - 1) or x in lose:
                    gone += 1
                    continue
            kept.append(x)
        out[doc] = (k, gone, None if text is None else "\n".join(kept))
    return out


def dice(a, b):
    grams = lambda t: {tuple(w[i : i + 2]) for w in [ALNUM.findall(low(t))] for i in range(max(1, len(w) - 1)) if w}
    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def check_packing(pieces, ids, size=2048):
    """Pieces against {doc: token ids}: each id once, sequences gapless, sizes powers of two."""
    at, sequences = Counter(), {}
    for p in sorted(pieces, key=lambda p: (str(p["doc_id"]), p["start"])):
        x = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(x) and p["length"] > 0
        part = x[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        at[p["doc_id"]] += p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert at == Counter({d: len(x) for d, x in ids.items()})
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= size and end & (end - 1) == 0


def crf_score(text, model):
    """A document's toxicity, word by word, by sums over both tags."""
    import math

    from splitaudit.llm import tokens as K
    from splitaudit.llm import toxicity

    w = K.words_of([(text or "").encode()], K.ALNUM_LOWER)
    most, tagged = 1e-6, 0
    if len(w.hash):
        emit = [model.bias + sum(float(model.weights[f]) for f in column) for column in toxicity.features(w).T]
        n, t = len(emit), model.trans
        forward = [[0.0, min(30, max(-30, emit[0]))]]
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        for e in emit[1:]:
            a, b = forward[-1]
            forward.append([add(a + t[0, 0], b + t[1, 0]), add(a + t[0, 1], b + t[1, 1]) + min(30, max(-30, e))])
        back = [[0.0, 0.0]]
        for e in reversed(emit[1:]):
            a, b = back[0][0], back[0][1] + min(30, max(-30, e))
            back.insert(0, [add(t[0, 0] + a, t[0, 1] + b), add(t[1, 0] + a, t[1, 1] + b)])
        p = [1 / (1 + math.exp(min(700, f[0] + b[0] - f[1] - b[1]))) for f, b in zip(forward, back, strict=True)]
        assert n == len(p)
        most, tagged = max(p), sum(x > 0.5 for x in p)
    most = min(1 - 1e-6, max(1e-6, most))
    z = math.log(most / (1 - most)) + math.log1p(tagged)
    return 1 / (1 + math.exp(-(model.scale * z + model.shift)))


def language(text, model):
    """Probabilities of a document's languages, gram by gram."""
    from splitaudit.llm import langid

    data = (text or "").encode()
    fold = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in data) + b"   "
    total = [0.0] * len(model.langs)
    for i in range(len(data)):
        for n in (2, 3, 4):
            code = 0
            for b in fold[i : i + n]:
                code = code * 257 + b
            h = (code + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - langid.BUCKET_BITS)
            total = [s + float(x) for s, x in zip(total, model.table[h], strict=True)]
    z = [(s / (3 * max(1, len(data))) + float(b)) / model.temperature for s, b in zip(total, model.bias, strict=True)]
    top = max(z)
    e = [2.718281828459045 ** (x - top) for x in z]
    return [x / sum(e) for x in e]
