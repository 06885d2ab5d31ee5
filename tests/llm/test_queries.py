"""Every registered query of the operators on small tables, against plain Python."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import corpus, prose, vectors

LANGS = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schn", "eit", "ung", "ver"], "cc": ["ção", "que", "lh", "os"]}


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents, benchmark items): a corpus with a text of over 1 MB, copies, toxic documents, languages, licences."""
    rng = random.Random(21)
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, None) for i, t in corpus(seed=4, n=48)]
    long = prose(rng, 180_000, 4000)
    rows += [(500, long, None), (501, long[:600_000] + "\n" + rows[0][1] + "\n" + long[600_000:], None), (502, "x" * 1_200_000, None), (503, long, None)]
    items = [(1, rows[0][1]), (2, "alpha1 Beta2"), (30, long[300_000:300_400]), (4, None)]
    for i in range(240):
        lang = list(LANGS)[i % 3]
        words = ["".join(rng.choice(LANGS[lang]) for _ in range(3)) for _ in range(rng.randrange(12, 50))]
        if i % 4 == 0:
            words[3:3] = ["nastyword", "vilething"]
        rows.append((1000 + i, " ".join(words), lang))
    rows += [(2000, "Some words.\n\nReleased under the MIT License.\n", None), (2001, "123 ... !", None)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    pages = [(i, "http://x", "é" * 700 if i % 3 == 0 else None if i == 4 else f"page {i}") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root), [(i, t) for i, t, _ in rows], items


def run(spark, tables, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, tables[0])


def by_id(frame, key="doc_id"):
    got = [r.asDict() for r in frame.collect()]
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def test_op1(spark, tables):
    got = by_id(run(spark, tables, "op1_benchmark_decontamination"))
    want = brute.contamination(tables[1], tables[2])
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} == want
    assert sum(w[4] for w in want.values()) > 5 and want[500][1] > 0 and not want[500][4]


def test_op2(spark, tables):
    got = by_id(run(spark, tables, "op2_ngram_jaccard_join"))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.jaccard(tables[1])
    assert got[503]["component_id"] == got[501]["component_id"] == 500


def test_op3(spark, tables):
    got = by_id(run(spark, tables, "op3_substring_dedup"))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute.repeats(tables[1])
    assert got[503]["n_removed"] == got[503]["n_words"] > 100_000


def test_op4(spark, tables):
    got = by_id(run(spark, tables, "op4_embedding_near_dedup"), "vec_id")
    assert len(got) == len(vectors()) and got[300]["n_links"] == 0 and got[91]["component_id"] == 7 and sum(r["kept"] for r in got.values()) < 300


def test_op5(spark, tables):
    from splitaudit.llm import toxicity

    got = by_id(run(spark, tables, "op5_toxicity"))
    assert len(got) == len(tables[1])
    assert all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [i for i in range(240) if fold(1000 + i, 3) == 1]
    assert sum(got[1000 + i]["predicted"] != int(i % 4 == 0) for i in held) <= 1 and len(held) > 50
    # the same scores from a field that is walked word by word
    learned = [(i, t, int(i % 4 == 0)) for i, t in ((i, dict(tables[1])[1000 + i]) for i in range(240)) if fold(1000 + i, 3) != 1]
    docs = spark.createDataFrame([(1000 + i, t) for i, t, _ in learned], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1000 + i, y) for i, _, y in learned], "doc_id long, toxic int"))
    for i, text in tables[1][:30] + tables[1][60:70]:
        assert abs(brute.crf_score(text, model) - got[i]["score"]) < 1e-6 if len(text or "") < 50_000 else True


def test_op6(spark, tables):
    from splitaudit.llm.licence_templates import TEMPLATES

    got = by_id(run(spark, tables, "op6_license_scan"))
    assert len(got) == len(tables[1]) and got[2000]["best_licence"] == "MIT" and got[2000]["best_dice"] == 1.0
    for i, text in tables[1]:
        if len(text or "") < 3000:
            lines = {n for n, t in TEMPLATES for x in (text or "").split("\n") if brute.dice(x, t) >= 0.9}
            assert lines <= set(got[i]["licences"].split(","))
    assert [i for i, r in got.items() if r["n_licences"]] == [2000]


def test_op7(spark, tables):
    got = by_id(run(spark, tables, "op7_warc"), "page_id")
    big = hashlib.sha1(("é" * 700).encode()).hexdigest()
    for i, r in got.items():
        html = "é" * 700 if i % 3 == 0 else "" if i == 4 else f"page {i}"
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if r["payload_digest"] == big and i != 9 else ("response", None))
    assert len(got) == 12


def test_op8(spark, tables):
    small = [(i, t) for i, t in tables[1] if len(t or "") < 400_000 or i in (500, 503)]
    got = by_id(run(spark, tables, "op8_line_dedup"))
    want = brute.line_dedup(small)
    for i in (r for r, _ in small):
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["kept_sha256"]) == (*want[i][:2], brute.sha(want[i][2] or ""))
    assert got[503]["n_removed"] == 1 and got[501]["n_removed"] >= 1 and got[502]["n_removed"] == 0


def test_op9(spark, tables):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from splitaudit.llm import packing

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in tables[1]}
    brute.check_packing([r.asDict() for r in run(spark, tables, "op9_packing").collect()], ids)


def test_op10(spark, tables):
    from splitaudit.llm import langid

    got = by_id(run(spark, tables, "op10_language_id"))
    assert len(got) == len(tables[1]) and all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in range(240) if fold(1000 + i, 4) == 2]
    assert all(got[1000 + i]["lang_pred"] == list(LANGS)[i % 3] for i in held) and len(held) > 40
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {i for i, t in tables[1] if not any(c.isalpha() for c in t or "")}
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    for i, text in tables[1][:40] + tables[1][60:70]:
        if any(c.isalpha() for c in text or "") and len(text) < 50_000:
            assert abs(max(brute.language(text, model)) - got[i]["score"]) < 1e-5


def test_sql_counterparts(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    from splitaudit.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'" + (" WHERE len(text) < 100000 OR text IS NULL" if t == "documents" else ""))
    for name, want in (("op1_benchmark_decontamination", lambda d: brute.contamination(d, tables[2])), ("op2_ngram_jaccard_join", brute.jaccard), ("op3_substring_dedup", brute.repeats)):
        small = [(i, t) for i, t in tables[1] if len(t or "") < 100_000]
        assert {r[0]: tuple(r[1:]) for r in con.execute(ORACLES[name]).fetchall()} == want(small)


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").where("1 = 0").write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op2_ngram_jaccard_join", "op3_substring_dedup", "op4_embedding_near_dedup", "op5_toxicity", "op6_license_scan", "op7_warc", "op8_line_dedup", "op9_packing", "op10_language_id", "pipeline"])
def test_empty_tables(spark, empty, name):
    assert run(spark, (empty,), name).collect() == []


def test_names_that_are_taken(spark):
    from splitaudit.llm import decontaminate, langid, licences, lines, toxicity

    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, Found string")
    none = toxicity.train([], [])
    for call in (
        lambda: decontaminate.match_benchmark(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")),
        lambda: toxicity.score(docs, none, out="found"),
        lambda: langid.identify(docs, langid.train([]), out="FOUND"),
        lambda: licences.scan_licences(docs, out="found"),
        lambda: lines.deduplicate(docs, counts="found"),
    ):
        with pytest.raises(ValueError):
            call()
    assert toxicity.score(docs.withColumn("toxicity", F.lit(1)), none).columns == ["doc_id", "text", "Found", "toxicity", "toxicity_1"]


def test_template_lines_give_rows_in_proportion(spark):
    from splitaudit.llm import lines as L

    sent = {}
    for n in (600, 2400):
        docs = spark.createDataFrame([(i, f"Record number {i:05d} of the archive was checked and found good.") for i in range(n)], "doc_id long, text string").repartition(4)
        keys = L._joined(docs.selectExpr("doc_id AS d", "text AS t").mapInArrow(L._scan(4), L.B.SCHEMA), 4, L.HOT)
        sent[n] = L._exploded(keys, L._MEMBER, ["k", "u", "ix", "sk"]).count() + L._exploded(keys, L._HOT, ["u"]).count()
        left = {r["doc_id"] for r in L.deduplicate(docs).collect() if r["text"]}
        near = lambda a, b: sum(x != y for x, y in zip(f"{a:05d}", f"{b:05d}", strict=True)) <= 2
        assert left == {i for i in range(n) if not any(near(i, j) for j in range(i))}
    assert sent[2400] <= 6 * sent[600]


def test_prefixes_split_until_groups_fit(spark, monkeypatch):
    """One prefix holds most suffixes: the trie goes deeper there, and no group holds more than its share."""
    from splitaudit.llm import substrings as S

    rng = random.Random(6)
    texts = ["the same start of every line here " + prose(rng, 40) for _ in range(300)]
    rows = spark.createDataFrame([(i, (t + " ") * 2) for i, t in enumerate(texts)], "d long, t string")
    monkeypatch.setattr(S, "SMALL_GROUP", 100)
    monkeypatch.setattr(S, "LOCAL_WORDS", 3000)
    trie, parts, again = S._prefixes(rows, 20, 64)
    leaves = trie._leaves()
    held = np.bincount(trie.part[leaves], weights=trie.count[leaves], minlength=parts)
    assert trie.level[leaves].max() >= 4 > trie.level[leaves].min() and again == 1 and parts == 64
    assert held.max() <= 2.5 * held.mean() and (trie.count[leaves & (trie.level < trie.levels)] <= max(100, held.sum() / parts + 1)).all()


def test_rows_of_any_key_in_a_long_list_of_vectors(spark):
    from splitaudit.llm.embeddings import near_duplicates

    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6))
    rows = [(i % 300, [float(v) for v in r]) for i, r in enumerate(x)]
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile_rows=64).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((i % 300, int(n)) for i, n in enumerate(close.sum(axis=1)))


def test_near_copies_are_found_by_prefixes(spark):
    """Within a group links come from prefix matches that whole sets confirm."""
    from splitaudit.llm.jaccard import _Block

    rng = random.Random(12)
    base = [rng.getrandbits(60) for _ in range(80)]
    members = []
    for u in range(60):
        t = sorted({*(x for x in base if rng.random() > rng.choice([0.02, 0.3])), *(rng.getrandbits(60) for _ in range(rng.randrange(8)))})
        base_len = len(t) - -(-75 * len(t) // 100)
        members.append((u, len(t), base_len, rng.choice([1, 2, 4]), np.array(t, dtype="<u8").tobytes()))
    sets = [set(np.frombuffer(m[4], dtype="<u8").tolist()) for m in members]
    links = {(a, b) for a in range(60) for b in range(60) if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    block = _Block(members, 75, 100)
    found = {(x, y) for x in range(60) for some in block.partners(*members[x][1:4], np.frombuffer(members[x][4], dtype="<u8"), x) for y in some}
    assert found == links and len(links) > 100
    forest = _Block(members, 75, 100).forest()
    assert set(forest) <= links and brute.union(forest, range(60)) == brute.union(links, range(60)) and len(forest) < 60


def test_repeated_rows_get_the_same_answer(spark, tables):
    from splitaudit.llm import decontaminate, langid, licences, toxicity

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("length(text) < 5000 or text is null").select("doc_id", "text", "lang")
    twice = docs.union(docs).repartition(5)
    bench = spark.read.parquet(f"{tables[0]}/benchmark.parquet")
    tox = toxicity.fit(docs, spark.read.parquet(f"{tables[0]}/labels.parquet"))
    lang = langid.fit(docs)
    for add in (lambda d: decontaminate.match_benchmark(d, bench), lambda d: toxicity.score(d, tox, out="found"), lambda d: licences.scan_licences(d, out="found"), lambda d: langid.identify(d, lang, out="found")):
        once = {r["doc_id"]: r["found"] for r in add(docs).collect()}
        got = [(r["doc_id"], r["found"]) for r in add(twice).collect()]
        assert len(got) == 2 * len(once) and all(once[i] == x for i, x in got)
