"""The pipeline, stage by stage, against plain Python."""

import brute
import pytest
from test_operators import corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from splitaudit.llm import packing

    rows = [(i, t) for i, t in corpus(seed=9, n=80)]
    toxic = [(1000 + i, f"plain words number {i} with nastyword{'s' * (i % 2)} in them and vilething too") for i in range(60)]
    clean = [(2000 + i, f"plain words number {i} with nothing in them at all and more of that kind") for i in range(120)]
    items = [(1, rows[-1][1]), (2, "alpha1 alpha2")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic + clean], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
            now.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "toxicity":
            assert not set(after) & {i for i, _ in toxic} and len(set(after) & {i for i, _ in clean}) >= 118 and len(after) >= len(rows) + 110
        elif name == "line_dedup":
            want = brute.line_dedup(list(before.items()))
            assert after == {d: t for d, (_, _, t) in want.items()}
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, (_, c) in brute.jaccard(list(before.items())).items() if d == c}
        elif name == "benchmark_decontamination":
            assert set(after) == {d for d, w in brute.contamination(list(before.items()), items).items() if not w[4]}
        else:
            tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
            brute.check_packing([r.asDict() for r in now.collect()], {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in before.items()})
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(r["length"] for r in now.collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, found string, part int, kind int, toxicity string, row_d long, u long, n_words string"


@pytest.fixture(scope="module")
def side(spark, tmp_path_factory):
    """A folder with labels and benchmark, and odd documents: null keys and texts, repeated rows, clashing names, a text of over 1 MB."""
    root = str(tmp_path_factory.mktemp("side"))
    toxic = [(1000 + i, f"plain words number {i} with nastyword in them and vilething too") for i in range(40)]
    clean = [(2000 + i, f"plain words number {i} with nothing in them at all and more of that kind") for i in range(80)]
    passage = " ".join(f"bench{k}" for k in range(30))
    long = "\n".join(f"{k} is a line of its own among {k * 7919 % 100_003} others {k * k % 99_991}" for k in range(26_000))
    texts = toxic + clean + [(None, "a text without a key, but with words enough"), (None, None), (None, "a text without a key, but with words enough"), (1, None), (1, None), (2, ""), (3, passage), (3, passage), (4, long), (5, long), (6, "\n \n"), (7, "one")]
    spark.createDataFrame([(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "bench1 bench2"), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, "y", 3, 4, "z") for i, t in texts], ODD).repartition(3)
    return root, docs, texts


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination"])
def test_stages_on_odd_rows(spark, side, name):
    root, docs, texts = side
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, root)
    assert got.schema.names == docs.schema.names
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    count = lambda i: sum(d == i for d, _ in rows)
    if name == "toxicity":
        assert sorted(map(str, rows)) == sorted(str(x) for x in texts if x[0] is None or not 1000 <= x[0] < 2000)
    elif name == "line_dedup":
        assert len(rows) == len(texts) and dict(rows)[4] == texts[-4][1] and dict(rows)[5].strip("\n") == "" and [t for d, t in rows if d == 3] == [texts[-5][1]] * 2
    elif name == "ngram_jaccard_join":
        assert [count(i) for i in (None, 1, 2, 3, 4, 5, 6, 7)] == [2, 2, 1, 1, 1, 0, 1, 1]  # texts without words all stay; of copies one
    else:
        assert [count(i) for i in (None, 1, 2, 3, 4, 5, 6, 7)] == [3, 2, 1, 0, 1, 1, 1, 1]
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.where("doc_id = -1"), root).collect() == []


def test_packing_stage_on_odd_rows(spark, side):
    pytest.importorskip("public_tokenizers")
    root, docs, texts = side
    got = corpus_pipeline.pack(spark, docs, root).collect()
    whole = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert whole[1] == 2 and whole[2] == 1 and whole[4] == whole[5] > 300_000 and whole[3] % 2 == 0
    assert corpus_pipeline.pack(spark, docs.where("doc_id = -1"), root).collect() == []
