"""The ten operators against plain Python, with nulls, empty and long texts, ties, repeats and empty tables."""

import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORDS = ["alpha", "Beta", "gamma", "delta.", "épsilon", "zeta", "Eta", "theta,", "iota9", "kappa"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, found string, part string, kind int"


def prose(rng, n, vocabulary=400):
    return " ".join(WORDS[rng.randrange(10)] + str(rng.randrange(vocabulary // 10)) for _ in range(n))


def corpus(seed=3, n=60):
    """(id, text) with copies, near copies, shared passages, repeated lines, junk, nulls and a long text."""
    rng = random.Random(seed)
    passage, line = prose(rng, 40), "This very line is found in many documents."
    texts = []
    for i in range(n):
        kind = i % 6
        text = "\n".join(prose(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 5)))
        if kind == 1 and texts:
            text = texts[rng.randrange(len(texts))] or ""
        elif kind == 2 and texts:
            words = (texts[rng.randrange(len(texts))] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{text} {passage} {prose(rng, 5)}\n{line}"
        elif kind == 4:
            text = f"{text}\n{line[:-1]}{'!' * (i % 3)}\n{line}"
        texts.append(text)
    texts += [None, "", " \t\n", "one", "word " * 3000, prose(rng, 20_000), "ABC abc", "\0 nul \0 here", passage, passage]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", "clash", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


def test_contamination(spark, rows):
    from splitaudit.llm.decontaminate import contaminated, decontaminate, hit_words, match_benchmark

    passage = rows[-1][1]
    items = [(1, passage), (10, "alpha1 beta2"), (2, "Beta1 " + passage[30:]), (3, None), (4, "..."), (None, "word word word"), (1, passage), (7, " ".join(rows[0][1].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, items)
    d = frame(spark, rows).drop("found")
    for block_words in (200_000, 15):
        got = match_benchmark(d, bench, block_words=block_words).select("doc_id", "found.n_words", hit_words().alias("h"), F.size("found.items").alias("i"), F.sha2(F.concat_ws(",", "found.items"), 256).alias("s"), contaminated().alias("c"))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    kept = decontaminate(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate(frame(spark, rows), bench, action="cut").collect()}
    assert cut[rows[-1][0]] == "" and cut[60] is None and len(cut) == len(rows)
    empty = bench.where("item_id = 99")
    assert {tuple(r["found"]["items"]) for r in match_benchmark(d, empty).collect()} == {()}
    assert match_benchmark(d.where("doc_id < 0"), bench).count() == 0


def test_longer_templates_are_reported_under_their_own_identifier():
    from splitaudit.llm.licence_templates import TEMPLATES
    from splitaudit.llm.licences import Scanner

    long = [(n, t) for n, t in TEMPLATES if len(t) > 300]
    got = list(Scanner(TEMPLATES, 0.9).scan([t.encode() for _, t in long]))
    assert [m[0][0] for m in got] == [n for n, _ in long] and "BSD-3-Clause" in dict(long)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton_finds_what_plain_search_finds(items, words, window):
    from splitaudit.llm.decontaminate import Matcher

    block = [(str(i), " ".join(x).encode()) for i, x in enumerate(items)]
    (hit, found), = Matcher(block, window).match([" ".join(words).encode()])
    want = brute.contamination([(0, " ".join(words))], [(i, t.decode()) for i, t in block], window)[0]
    assert (len(hit), int(hit.sum()), len(found), brute.sha(",".join(sorted(found)))) == want[:4]


def test_jaccard(docs, rows):
    from splitaudit.llm.jaccard import jaccard_components, one_per_component

    want = brute.jaccard(rows)
    got = jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    kept = one_per_component(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}
    assert jaccard_components(docs.where("doc_id < 0")).count() == 0


def test_jaccard_dealt_in_two_steps(docs, rows, monkeypatch):
    from splitaudit.llm import blobs, jaccard

    monkeypatch.setattr(blobs, "MAX_PARTS", 3)
    monkeypatch.setattr(blobs, "RECUT_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "_groups", lambda docs, text: blobs.whole_groups(10))
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()} == brute.jaccard(rows)


def test_jaccard_writes_edges_once(docs, rows, monkeypatch):
    """Edge lists go into `components`, which writes them itself: no table is written that only it would read."""
    from splitaudit.llm import jaccard

    written, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: written.append(name) or cut(df, name))
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()} == brute.jaccard(rows)
    assert sorted({"links", "hub-pairs"} & set(written)) == []
    assert {"sets", "units", "hubs", "merged-hubs", "blocks"} <= set(written)


def test_jaccard_of_a_large_near_group_and_null_keys(spark):
    from splitaudit.llm import jaccard

    rng = random.Random(5)
    base = prose(rng, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    block, jaccard.BLOCK_TOKENS = jaccard.BLOCK_TOKENS, 1500
    try:
        got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        jaccard.BLOCK_TOKENS = block
    assert got == brute.jaccard(rows)
    odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "x")], "doc_id long, text string")
    both = odd.union(spark.createDataFrame([(3, "other words"), (None, "x"), (None, ""), (None, None), (None, "")], "doc_id long, text string"))
    assert sorted(map(tuple, jaccard.one_per_component(both).collect()), key=str) == sorted([(3, "a b c"), (3, "other words"), (None, "x"), (None, ""), (None, None), (None, "")], key=str)
    assert sorted(map(tuple, jaccard.jaccard_components(odd).collect()), key=str) == sorted([(None, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, None)], key=str)


def test_repeated_substrings(docs, rows, spark):
    from splitaudit.llm.substrings import deduplicate

    assert {r[0]: tuple(r)[1:] for r in deduplicate(docs).collect()} == brute.repeats(rows)
    kept = {r["doc_id"]: r["kept_text"] for r in deduplicate(docs, kept_text=True).collect()}
    assert kept[60] is None and kept[61] == "" and kept[64].split() == ["word"]
    assert deduplicate(docs.where("doc_id < 0")).count() == 0
    twice = spark.createDataFrame([(1, "w " * 25), (1, "w " * 25), (None, "w " * 25)], "doc_id long, text string")
    assert sorted(((r[0] or -1), r[2]) for r in deduplicate(twice).collect()) == [(-1, 25), (1, 24), (1, 24)]


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[3] + rng.normal(size=(40, 16)) * 0.2
    x[90:120] = x[7]
    x[120:130] = x[8] * rng.uniform(0.5, 2, size=(10, 1))
    out = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    return out + [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0] * 15 + [float("nan")]), (304, [1.0] * 15 + [None]), (305, [float("inf")] + [1.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [-0.0] * 15 + [5.0]), (309, [0.0] * 15 + [5.0])]


@pytest.mark.parametrize("tile", [2048, 40])
def test_embeddings(spark, tile):
    from splitaudit.llm.embeddings import near_duplicates

    rows = vectors()
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95]
    comps = brute.union(links, [i for i, _ in rows])
    want = {i: (sum(i in x for x in links), comps[i], comps[i] == i) for i, _ in rows}
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = near_duplicates(table, tile_rows=tile)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert near_duplicates(table.where("vec_id < 0")).count() == 0


def test_vectors_of_repeated_ids_have_links_of_their_own(spark):
    from splitaudit.llm.embeddings import near_duplicates

    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(5, 0, 5, True), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False), (7, 3, 5, False)]


def test_crowded_leaves_are_several_tiles():
    from splitaudit.llm.embeddings import Tiles, Tree

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 12))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    tree = Tree(x[:500], 5)
    y = x @ tree.rotation[:, : tree.dims]
    tiles = Tiles(tree, np.bincount(tree.homes(y), minlength=5), 300)
    homes = tiles.homes(y, np.arange(len(y)))
    assert tiles.total >= 14 and np.bincount(homes).max() < 420
    row, tile = tiles.visits(y, homes, 0.4)
    met = set(zip(row.tolist(), tile.tolist(), strict=True))
    near = np.argwhere(np.triu(x @ x.T >= 1 - 0.4**2 / 2, 1))
    assert len(near) > 20
    for a, b in near.tolist():  # one of the two visits the other's tile, or they share one
        assert (homes[a] == homes[b]) != (((a, homes[b]) in met) != ((b, homes[a]) in met))
    assert len(row) / len(x) <= tiles.total / 2


def test_toxicity(spark, rows):
    from splitaudit.llm import toxicity

    rng = random.Random(2)
    made = []
    for i in range(400):
        words = prose(rng, rng.randrange(5, 80)).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyish", "nastily", "vileness"]))
        made.append((i, " ".join(words), int(i % 5 == 0)))
    d = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i < 300] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = {r["doc_id"]: r["t"] for r in toxicity.score(d, model, out="t").collect()}
    wrong = sum((got[i]["score"] >= toxicity.CUT) != bool(y) for i, _, y in made if i >= 300)
    assert wrong <= 2
    text = made[305][1]
    assert {text.encode()[s["start"] : s["end"]].decode()[:4] for s in got[305]["spans"]} <= {"nast", "vile"} and got[305]["spans"]
    odd = {r["doc_id"]: r["t"] for r in toxicity.score(frame(spark, rows), model, out="t").collect()}
    assert len(odd) == len(rows) and odd[60]["score"] == odd[61]["score"] < toxicity.CUT and all(0 <= r["score"] <= 1 for r in odd.values())
    none = toxicity.fit(d, labels.where("toxic = 7"))
    assert all(r["t"]["score"] < toxicity.CUT for r in toxicity.score(d, none, out="t").collect())


def test_forward_backward_equals_enumeration():
    from itertools import product

    from splitaudit.llm.toxicity import marginals

    rng = np.random.default_rng(0)
    emit, first, trans = rng.normal(size=9), np.array([0, 4, 4, 5, 9]), rng.normal(size=(2, 2))
    p, joint = marginals(emit, first, trans, pairs=True)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first, first[1:], strict=False):
        total, own, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for tags in product((0, 1), repeat=b - a):
            moves = list(zip(tags, tags[1:], strict=False))
            w = np.exp(sum(e for e, y in zip(emit[a:b], tags, strict=True) if y) + sum(trans[m] for m in moves))
            total += w
            own += w * np.array(tags)
            for m in moves:
                both[m] += w
        if b > a:
            want[a:b] = own / total
            pairs += both / total
    assert np.allclose(p, want) and np.allclose(joint, pairs)


def test_long_texts_are_walked_in_parts(monkeypatch):
    from splitaudit.llm import toxicity

    rng = np.random.default_rng(5)
    first = np.cumsum([0, 0, 3, 900, 1, 64, 65, 4000, 7, 63, 0])
    emit, trans = rng.normal(size=first[-1]) * 6, rng.normal(size=(2, 2)) * 2
    monkeypatch.setattr(toxicity, "PART", 10_000)
    want, pairs = toxicity.marginals(emit, first, trans, pairs=True)
    for part in (64, 7, 1):
        monkeypatch.setattr(toxicity, "PART", part)
        got, joint = toxicity.marginals(emit, first, trans, pairs=True)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12) and np.allclose(joint, pairs)


def test_licences(spark, rows):
    from splitaudit.llm.licence_templates import RIVALS, TEMPLATES
    from splitaudit.llm.licences import scan_licences

    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    texts = [(1, f"Foo\nReleased under the MIT License.\nbar"), (2, f"x y\n\nCopyright (c) 2001 Someone\n{mit.replace('. ', '.' + chr(10))}\n\nz"), (3, "MIT"), (4, None), (5, ""), (6, "the licence of a MIT student"), (7, mit + " and so on"), (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["l"] for r in scan_licences(frame(spark, texts), out="l").collect()}
    assert [[m["licence"] for m in got[i]] for i in range(1, 9)] == [["MIT"], ["MIT"], [], [], [], [], ["MIT"], ["CC-BY-NC-4.0", "Apache-2.0"]]
    assert got[2][0]["scope"] == "paragraph" and got[1][0]["dice"] == 1.0 and texts[0][1][got[1][0]["start"] : got[1][0]["end"]] == "Released under the MIT License."
    rng = random.Random(9)
    mixed = []
    for i in range(60):  # statements and parts of texts with some words changed, among prose
        words = rng.choice(TEMPLATES)[1].split()
        begin = rng.randrange(max(1, len(words) - 40))
        words = words[begin : begin + rng.randrange(6, 60)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        mixed.append((i, "\n".join([prose(rng, 8), " ".join(words), prose(rng, 8)])))
    mixed += [(100 + i, "prose\n" + t + "\nprose") for i, (_, t) in enumerate(TEMPLATES)]
    for least in (0.6, 0.9):
        want = {(i, n): max(brute.dice(x, y) for x in t.split("\n") for m, y in TEMPLATES if m == n) for i, t in mixed for n in {m for m, _ in TEMPLATES}}
        want = {k: v for k, v in want.items() if v >= least}
        got = {(r["doc_id"], m["licence"]): m for r in scan_licences(frame(spark, mixed), min_dice=least, out="l").collect() for m in r["l"]}
        assert len(want) > 100
        for (i, n), v in want.items():  # recall: lines are among the runs; a better match of a rival may stand for them
            rivals = [got[i, k]["dice"] for r in RIVALS if n in r for k in r - {n} if (i, k) in got]
            assert (got[i, n]["dice"] if (i, n) in got else max(rivals)) >= v - 1e-9
        text = {i: t.encode() for i, t in mixed}
        for (i, n), m in got.items():  # precision: what is reported has that Dice with a template of that licence
            part = text[i][m["start"] : m["end"]].decode()
            assert m["scope"] != "words" or max(brute.dice(part, y) for k, y in TEMPLATES if k == n) >= m["dice"] - 1e-9 >= least - 1e-9
    assert scan_licences(frame(spark, texts).where("doc_id < 0")).count() == 0


def test_licences_inside_longer_texts():
    from splitaudit.llm.licence_templates import TEMPLATES
    from splitaudit.llm.licences import Scanner

    prose_ = "Some words about a project that are long enough to count for something here."
    notice = {n: next(t for m, t in TEMPLATES if m == n and 300 < len(t) < 2000) for n in ("MIT", "Apache-2.0", "GPL-3.0")}
    breaks = {"MIT": ["The above copyright notice", "THE SOFTWARE IS PROVIDED"], "Apache-2.0": ["You may obtain", "Unless required"], "GPL-3.0": ["This program is distributed", "You should have received"]}
    texts, names = [], []
    for n, text in notice.items():
        for b in breaks[n]:
            assert b in text
            text = text.replace(b, "\n\n" + b)
        texts.append(f"# Title\n\n{prose_} {prose_}\n\nCopyright (c) 2001 Someone\n\n{text}\n\n{prose_}\n{prose_}\n")
        names.append(n)
    texts.append("# Title\n\nThis project is great. It was Released under the MIT License, as is its sibling. " + prose_)
    names.append("MIT")
    got = list(Scanner(TEMPLATES, 0.9).scan([t.encode() for t in texts]))
    assert [[m[0] for m in ms if m[1] >= 0.95] for ms in got] == [[n] for n in names]
    assert texts[3].encode()[got[3][0][3] : got[3][0][4]] == b"Released under the MIT License" and got[3][0][2] == "words"
    assert texts[0].encode()[got[0][0][3] :].startswith(b"Permission is hereby granted")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=24), st.lists(st.lists(st.sampled_from("abcdef"), min_size=2, max_size=9), min_size=1, max_size=3), st.sampled_from([0.5, 0.8, 0.9]))
def test_every_run_of_words_is_compared(words, templates, t):
    from splitaudit.llm.licences import Scanner

    known = [(str(i), " ".join(x)) for i, x in enumerate(templates)]
    (got,) = Scanner(known, t).scan([" ".join(words).encode()])
    want = {n: max((brute.dice(" ".join(words[a:b]), x) for a in range(len(words)) for b in range(a + 1, len(words) + 1)), default=0.0) for n, x in known}
    assert {m[0]: round(m[1], 9) for m in got} == {n: round(d, 9) for n, d in want.items() if d >= t - 1e-12}


def test_warc_round_trip(spark, tmp_path):
    from splitaudit.llm import warc

    big, other = "é" * 600, "y" * 1000
    pages = [(1, "http://a\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "a\r\n\r\nWARC/1.0\r\n\r\n"), (None, "u", big), (8, "u", "z" * 3_000_000), (10, "", "")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.with_record_types(table), path, bundle_bytes=3000, bundles_per_file=2)
    names = [f.name for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    assert len(names) > 1 and all(n.endswith(".warc.gz") for n in names)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert len(got) == len(pages) and all(r["gap_end"] is None for r in got.values())
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == __import__("hashlib").sha1(data).hexdigest()
        assert got[i]["record_type"] == ("revisit" if i in (1, 2) else "response") and got[i]["refers_to"] == (9 if i in (1, 2) else None)
        assert got[i]["payload"] == (None if i in (1, 2) else data)


def test_warc_salvage():
    from splitaudit.llm.warc import Gap, Record, gzip_member, record_bytes, salvage
    import hashlib

    def record(i, text="payload"):
        return record_bytes(i, "u", text.encode(), hashlib.sha1(text.encode()).hexdigest())

    members = [gzip_member(record(i, f"text {i} " * 50)) for i in range(6)]
    whole = b"".join(members)
    assert [type(x) for x in salvage(whole)] == [Record] * 6
    at = len(members[0]) + len(members[1]) + 40
    broken = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
    found = list(salvage(broken))
    assert [x.headers["warc-record-id"] for x in found if isinstance(x, Record)] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    gap, = [x for x in found if isinstance(x, Gap)]
    assert (gap.start, gap.end) == (len(members[0] + members[1]), len(b"".join(members[:3])))
    for n in (1, 30, len(members[5]) - 1):
        cut = list(salvage(whole[:-n]))
        assert sum(isinstance(x, Record) for x in cut) == 5 and isinstance(cut[-1], Gap) and cut[-1].end == len(whole) - n
    plain = record(1) + b"junk" + record(2) + record(3).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n") + members[4] + record(5)
    found = list(salvage(plain))
    assert [x.headers["warc-record-id"][-2] for x in found if isinstance(x, Record)] == ["1", "2", "4", "5"]
    assert [x.reason for x in found if isinstance(x, Gap)] == ["no version line", "payload digest differs"]
    assert list(salvage(b"")) == [] and [type(x) for x in salvage(b"no archive")] == [Gap]


def test_lines_and_substrings_dealt_in_two_steps(docs, rows, monkeypatch):
    from splitaudit.llm import blobs, lines, substrings

    monkeypatch.setattr(blobs, "MAX_PARTS", 3)
    monkeypatch.setattr(blobs, "RECUT_BYTES", 20_000)
    monkeypatch.setattr(lines, "_groups", lambda docs, text: blobs.whole_groups(10))
    got = lines.deduplicate(docs, counts="counts").collect()
    assert {r["doc_id"]: (r["counts"]["lines"], r["counts"]["removed"], r["text"]) for r in got} == brute.line_dedup(rows)
    prefixes = substrings._prefixes
    monkeypatch.setattr(substrings, "_prefixes", lambda *a: (*prefixes(*a)[:2], 3))
    assert {r[0]: tuple(r)[1:] for r in substrings.deduplicate(docs).collect()} == brute.repeats(rows)


def test_lines(docs, rows, spark):
    from splitaudit.llm.lines import deduplicate

    want = brute.line_dedup(rows)
    got = deduplicate(docs, counts="counts")
    assert got.columns == [*docs.columns, "counts"]
    assert {r["doc_id"]: (r["counts"]["lines"], r["counts"]["removed"], r["text"]) for r in got.collect()} == want
    assert sum(n for _, n, _ in want.values()) > 20
    assert deduplicate(docs.where("doc_id < 0")).count() == 0
    odd = spark.createDataFrame([(1, "the same line of some length"), (1, "the same line of some length"), (None, "the same line of some lengths")], "doc_id long, text string")
    assert sorted(((r[0] or -1), r[1]) for r in deduplicate(odd).collect()) == [(-1, ""), (1, "the same line of some length"), (1, "the same line of some length")]


def test_short_lines_lose_their_exact_repeats(spark):
    from splitaudit.llm.lines import deduplicate

    texts = [(1, "Les.\n\nshort one\nLes.\n}"), (2, "Les.\nshort onf\n你好\n}"), (3, "你好\n\nshort one\nx"), (4, None), (5, "")]
    got = {r["doc_id"]: (r["text"], r["c"]["lines"], r["c"]["removed"]) for r in deduplicate(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), counts="c").collect()}
    assert got == {1: ("Les.\n\nshort one\n}", 4, 1), 2: ("short onf\n你好", 4, 2), 3: ("\nx", 3, 2), 4: (None, 0, 0), 5: ("", 0, 0)}


def test_near_lines_of_wide_characters(spark):
    from splitaudit.llm.lines import deduplicate, tau

    rng = random.Random(5)
    lines = []
    for letters in ("的一是不了人我在有他这中大来上", "abcdeéüß日", "ab😀é"):
        for n in [*range(5, 26), 41, 42]:
            x = "".join(rng.choice(letters) for _ in range(n))
            lines.append(x)
            for edits in (1, 2, 3):
                y = list(x)
                for _ in range(edits):
                    k = rng.randrange(len(y))
                    y[k : k + rng.randrange(2)] = rng.choice(["", "国", "z", "é", "😀"])
                lines.append("".join(y))
    lines = [x for x in dict.fromkeys(lines) if x]
    size = [len(x.encode()) for x in lines]
    lose = {j for i in range(len(lines)) for j in range(i + 1, len(lines)) if (t := int(tau(np.array(min(size[i], size[j]))))) > 0 and abs(len(lines[i]) - len(lines[j])) <= t and brute.edits(lines[i], lines[j]) <= t}
    got = {r["doc_id"]: r["text"] for r in deduplicate(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)).collect()}
    assert {i for i, x in got.items() if x == ""} == lose and len(lose) > 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=14), st.binary(max_size=14)), min_size=1, max_size=4), st.text("ab", max_size=30), st.integers(0, 4), st.integers(0, 3))
def test_banded_distance(pairs, text, n, limit):
    from splitaudit.llm.lines import within

    pairs = [*pairs, (text.encode(), (text[: n * 2] + "x" * (n % 3) + text[n * 2 + n % 2 :]).encode())]
    got = within([a for a, _ in pairs], [b for _, b in pairs], limit)
    assert got.tolist() == [brute.edits(a, b) <= limit for a, b in pairs]


def test_packing(spark, rows, docs):
    from splitaudit.llm import packing

    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for size, ranges in ((2048, 3), (16, 1)):
        got = [r.asDict() for r in packing.pack(docs, path, size=size, ranges=ranges).collect()]
        brute.check_packing(got, ids, size)
        assert all(np.frombuffer(p["ids"], "<u4").tolist() == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]] for p in got)
    assert packing.pack(docs.where("doc_id < 0"), path).count() == 0
    odd = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")
    assert sum(p["length"] for p in packing.pack(odd, path).collect()) == 6
    with pytest.raises(ValueError):
        packing.pack(docs, path, size=1000)


def test_literals_of_added_tokens_are_those_tokens():
    from splitaudit.llm import packing

    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a log line <|endoftext|> more text", "<|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|><|endoftext|>é", "<|endoftext", ""]
    encode = packing.encoder(path)
    assert encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in encode(texts)[0] and encode.__name__ == "by_tiktoken"


def test_hilbert_curve_is_one_path():
    from splitaudit.llm.packing import hilbert

    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert(grid, 3))
    assert sorted(hilbert(grid, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_language(spark, rows):
    from splitaudit.llm import langid

    rng = random.Random(4)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schn", "eit", "ung", "ver"], "cc": ["ção", "que", "lh", "os"]}
    made = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(rng.randrange(4, 60))), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 80)]
    d = spark.createDataFrame([(i, t, lang if i % 4 else None) for i, t, lang in made], "doc_id long, text string, lang string")
    model = langid.fit(d)
    got = {r["doc_id"]: r["l"] for r in langid.identify(d, model, out="l").collect()}
    assert sum(got[i]["lang"] == lang for i, _, lang in made if i % 4 == 0) >= 58
    odd = {r["doc_id"]: r["l"] for r in langid.identify(frame(spark, [*rows, (900, "123 ...!"), (901, "日本")]), model, out="l").collect()}
    assert [odd[i]["lang"] for i in (60, 61, 62, 900)] == ["und"] * 4 and odd[901]["lang"] != "und" and odd[60]["score"] == 0
    nothing = langid.fit(d.where("lang = 'zz'"))
    assert {r["l"]["lang"] for r in langid.identify(d, nothing, out="l").collect()} == {"und"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), max_size=5))
def test_words_are_those_of_the_patterns(texts):
    from splitaudit.llm import tokens as K

    data = K.encode(texts)
    for table, pattern, change in ((K.SPACE, brute.WHITE, str), (K.ALNUM_LOWER, brute.ALNUM, brute.low)):
        w = K.words_of(data, table)
        for i, t in enumerate(texts):
            a, b = w.first[i], w.first[i + 1]
            assert [w.raw[x:y].tobytes().decode() for x, y in zip(w.start[a:b], w.end[a:b], strict=True)] == [t.encode()[m[0] : m[1]].decode() for m in _spans(pattern, change(t))]


def _spans(pattern, text):
    for m in pattern.finditer(text):
        yield len(text[: m.start()].encode()), len(text[: m.end()].encode())


def test_components(spark):
    from splitaudit.llm.common import components

    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute.union(real, {x for e in real for x in e})
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_fold_is_that_of_the_contract(spark):
    from splitaudit.llm.common import crc_mod

    got = spark.range(50).select("id", crc_mod(F.col("id"), 3).alias("m")).collect()
    assert all(zlib.crc32(str(r["id"]).encode()) % 3 == r["m"] for r in got)
