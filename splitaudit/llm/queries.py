"""The ten operators as registered queries: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, new_path


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by every benchmark item, windows of 13 words."""
    from .decontaminate import contaminated, hit_words, match_benchmark

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = match_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at Jaccard 0.75 of 5-word shingles."""
    from .jaccard import jaccard_components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, n=5, threshold=(75, 100))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier window of 20 words."""
    from .substrings import deduplicate

    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    from .embeddings import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def _learnable_labels(spark: SparkSession, sf_dir: str, m: int = 3, left_out: int = 1) -> DataFrame:
    """Label rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return labels.where(crc_mod(F.col("doc_id"), m) != left_out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learns from labels outside the fold crc32(doc_id) mod 3 = 1."""
    from . import toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, _learnable_labels(spark, sf_dir))
    scored = toxicity.score(docs, model, out="toxicity")
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= toxicity.CUT).cast("int").alias("predicted"),
        F.size("toxicity.spans").cast("long").alias("n_spans"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from documents outside the fold crc32(doc_id) mod 4 = 2."""
    from . import langid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model, out="language")
    return found.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.confident").alias("confident"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document's lines, paragraphs or whole text state."""
    from .licences import scan_licences

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licences(docs, out="licences")
    best = F.element_at("licences", 1)
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.transform("licences", lambda x: x["licence"])), ",").alias("licences"),
        F.when(F.size("licences") > 0, best["licence"]).alias("best_licence"),
        F.when(F.size("licences") > 0, best["dice"]).alias("best_dice"),
        F.when(F.size("licences") > 0, best["scope"]).alias("scope"),
        F.when(F.size("licences") > 0, best["start"]).alias("start"),
        F.when(F.size("licences") > 0, best["end"]).alias("end"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    from . import warc

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    warc.write_warc(warc.with_record_types(pages), path)
    records = warc.read_warc(spark, path).where("gap_end is null")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near-duplicate lines of all documents."""
    from .lines import deduplicate

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = deduplicate(docs, counts="counts")
    return found.select(
        "doc_id",
        F.col("counts.lines").alias("n_lines"),
        F.col("counts.removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids of the 50k byte-level BPE."""
    from . import packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack(docs, packing.tokenizer_path("byte_bpe_50k.json"), ids=False)


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_substring_dedup, op4_embedding_near_dedup, op5_toxicity, op6_license_scan, op7_warc, op8_line_dedup, op9_packing, op10_language_id)}
#: A-Z lowered, nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), bw AS (
            SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0
        ), win AS (
            SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM bw
        ), w AS (
            SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d
        ), grams AS (
            SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead FROM w
        ), runs AS (
            SELECT doc_id, pos, n, array_to_string(ahead[1:n], ' ') AS g FROM grams CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(ahead) >= n
        ), found AS (
            SELECT doc_id, pos, n, item FROM runs JOIN win USING (n, g)
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), w AS (
            SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d
        ), g AS (
            SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM w
        ), s AS (
            SELECT DISTINCT doc_id, s FROM g WHERE pos <= n - 4 OR (n < 5 AND pos = 1)
        ), z AS (
            SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
        ), o AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT x, y FROM o JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.size + b.size - shared)
        ), reach(x, y) AS (
            SELECT x, y FROM l
            UNION
            SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x
        ), c AS (
            SELECT x, min(y) AS least FROM reach GROUP BY x
        )
        SELECT d.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(c.least, d.doc_id)) AS BIGINT) AS component_id
        FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
    """,
    "op3_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), w AS (
            SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d
        ), g AS (
            SELECT doc_id, n, pos, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM w
        ), r AS (
            SELECT doc_id, pos, word, pos <= n - 19 AND row_number() OVER (PARTITION BY pos <= n - 19, s ORDER BY doc_id, pos) > 1 AS again FROM g
        ), k AS (
            SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
        ), t AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)
    """,
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(x, y) AS (
            SELECT x, y FROM l
            UNION
            SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x
        ), n AS (
            SELECT x, count(*) AS n_links FROM l GROUP BY x
        ), c AS (
            SELECT x, min(y) AS least FROM reach GROUP BY x
        )
        SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links,
               CAST(least(v.vec_id, coalesce(least, v.vec_id)) AS BIGINT) AS component_id,
               v.vec_id <= coalesce(least, v.vec_id) AS kept
        FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN c ON c.x = v.vec_id
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
        ), m AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM d
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < response THEN response END AS refers_to
        FROM m
    """,
}
