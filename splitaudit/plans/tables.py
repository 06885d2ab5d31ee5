"""Audits of tables: every operator as a registered query, and its SQL counterpart.

Rows of the driver's tables stand for records; the operators are those of file audits.  A row's
split follows from its number: eight of ten train, one validation, one test.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from splitaudit.functions import scalars as S
from splitaudit.operators import catalog as C
from splitaudit.operators import evidence as E
from splitaudit.operators.rules import BY_ID, RULES
from splitaudit.plans.audit import diagnostics_frame
from splitaudit.plans.policy import conservative

SPLITS = ["test", "train", "validation"]
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(number: Column) -> Column:
    return F.when(number % 10 < 8, "train").when(number % 10 == 8, "validation").otherwise("test")


def _catalog(rows: DataFrame, number: str, path: Column, **columns: Column | str) -> DataFrame:
    """Records of a table; columns that a query does not give are null or plain."""
    given = {
        "ord": F.col(number).cast("long"),
        "split": split_of(F.col(number)),
        "source_namespace": F.lit("local"),
        "path": path,
        "split_fold": F.lit(None).cast("string"),
        "namespace_fold": F.lit(None).cast("string"),
        "media_type": F.lit("raster"),
        "access_issue": F.lit(None).cast("string"),
        "hash_failed": F.lit(False),
        "parse_error": F.lit(None).cast("string"),
        "patient_id_status": F.lit(None).cast("string"),
        "modality": F.lit(None).cast("string"),
        "number_of_frames": F.lit(None).cast("long"),
        **{k: F.lit(None).cast("string") for k in C.KEYS},
    }
    given |= {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    return C.with_issues(rows.select(*[v.alias(k) for k, v in given.items()]))


def _keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)


def _numbered(records: DataFrame) -> DataFrame:
    return C.number_records(records, C.artifact_order(), _keep)


def _padded(number: str) -> Column:
    return F.lpad(F.col(number).cast("string"), 12, "0")


def _found(catalog: DataFrame, rule_id: str) -> DataFrame:
    """Findings in flat columns, which compare across engines."""
    found = E.findings(catalog, [BY_ID[rule_id]], SPLITS)
    return found.select("rule_id", "component_id", F.array_join("splits", "|").alias("splits"), F.size("record_aliases").cast("long").alias("records"), F.array_join("record_aliases", ",").alias("record_aliases"), "observed_fact")


def exact_content_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _catalog(docs, "doc_id", _padded("doc_id"), source_namespace=F.col("source"), file_sha256=F.sha2(F.col("text").cast("binary"), 256))


def q_exact_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text in different splits."""
    return _found(_numbered(exact_content_records(spark, sf_dir)), "ML001")


def q_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the catalog's total order."""
    return _numbered(exact_content_records(spark, sf_dir)).select(F.col("ord").alias("doc_id"), "alias", "split", "source_namespace")


def q_scoped_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer in one priority class, across splits."""
    token = F.sha2(F.concat_ws("\u001f", "o_orderpriority", F.col("o_custkey").cast("string")), 256)
    rows = _catalog(_read(spark, sf_dir, "orders"), "o_orderkey", _padded("o_orderkey"), source_namespace=F.col("o_orderpriority"), media_type="dicom", patient_id_status="usable", patient_group_token=token)
    return _found(_numbered(rows), "ML101")


def q_scoped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and type, across splits: few keys, large groups."""
    token = F.sha2(F.concat_ws("\u001f", "event_type", F.col("user_id").cast("string")), 256)
    rows = _catalog(_read(spark, sf_dir, "events"), "event_id", _padded("event_id"), source_namespace=F.col("event_type"), media_type="dicom", patient_id_status="usable", patient_group_token=token)
    return _found(_numbered(rows), "ML101")


def _lineitem_groups(rule_id: str, column: str, *keys: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = F.sha2(F.concat_ws(".", *[F.col(k).cast("string") for k in keys]), 256)
        # rows of lineitem are not unique: those of equal path and number have equal keys and splits, so their order among them shows nowhere
        path = F.concat_ws("-", _padded("l_orderkey"), _padded("l_linenumber"), _padded("l_suppkey"))
        rows = _catalog(_read(spark, sf_dir, "lineitem"), "l_partkey", path, media_type="dicom", patient_id_status="usable", **{column: token})
        return _found(_numbered(rows), rule_id)

    query.__doc__ = f"Line items that share {', '.join(keys)} across splits of their parts."
    return query


q_study = _lineitem_groups("ML102", "study_uid_token", "l_orderkey")
q_series = _lineitem_groups("ML103", "series_uid_token", "l_orderkey", "l_suppkey")
q_instance = _lineitem_groups("ML104", "sop_uid_token", "l_orderkey", "l_linenumber")


def q_no_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by turn: all turns are in one split, so nothing crosses, though keys are shared; by conversation some would."""
    rows = [_catalog(_read(spark, sf_dir, "conversations"), n, _padded("conv_id"), file_sha256=F.sha2(F.col("role"), 256)) for n in ("turn", "conv_id")]
    rule = BY_ID["ML001"]

    def counted(name: str, records: DataFrame) -> DataFrame:
        catalog = records.withColumn("alias", F.col("path"))
        shared = catalog.where(rule.evaluated()).groupBy(rule.key).count().where("count > 1").agg(F.count("*").alias("shared_keys"))
        crossing = E.findings(catalog, [rule], SPLITS).agg(F.count("*").alias("findings"))
        return shared.crossJoin(crossing).select(F.lit(name).alias("split_by"), "shared_keys", "findings")

    return counted("turn", rows[0]).union(counted("conversation", rows[1]))


def _sentences(df: DataFrame, number: str) -> DataFrame:
    """(n, place, sentence) of the texts' sentences of some length."""
    parts = df.select(F.col(number).alias("n"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.\n]")).alias("place", "sentence"))
    return parts.select("n", "place", F.trim("sentence").alias("sentence")).where(F.length("sentence") >= 20)


def q_benchmark_contam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that documents and benchmark items share: the source table is the split."""
    sides = [(_sentences(_read(spark, sf_dir, "documents"), "doc_id"), "train"), (_sentences(_read(spark, sf_dir, "benchmark"), "item_id"), "test")]
    path = F.concat_ws("-", _padded("n"), _padded("place"))
    parts = [_catalog(df, "n", path, split=F.lit(name), file_sha256=F.sha2(F.col("sentence").cast("binary"), 256)) for df, name in sides]
    return _found(_numbered(parts[0].unionByName(parts[1])), "ML001")


def q_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media type of made-up paths of pages."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".DCM", ".dicom", ".png", ".TIFF", ".txt", "", ".tar.gz")]), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/data/.d/p"), F.col("page_id").cast("string"), suffix)
    return _read(spark, sf_dir, "pages").select("page_id", S.media_type(path, F.col("page_id") % 2 == 0).alias("media_type"), S.path_suffix(path).alias("suffix"))


def _patient_id() -> Column:
    n = F.col("user_id") % 20
    return F.when(n == 0, None).when(n == 1, "Anon").when(n == 2, "00-0").when(n == 3, "x_x").when(n == 4, "---").otherwise(F.concat(F.lit("P-"), F.col("user_id").cast("string")))


def q_pid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of made-up patient identifiers of events."""
    return _read(spark, sf_dir, "events").select("event_id", S.patient_id_status(_patient_id()).alias("status"))


def q_uid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of made-up UIDs of orders; number of frames."""
    n = F.col("o_orderkey")
    uid = F.when(n % 5 == 0, F.concat(F.lit("1.02."), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit("1.2."), F.repeat(F.lit("9"), 70))).when(n % 5 == 2, "").otherwise(F.concat(F.lit("1.2."), n.cast("string"), F.lit(".0")))
    frames = F.when(n % 3 == 0, "x").when(n % 3 == 1, F.concat(F.lit(" "), (n % 9).cast("string")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", S.valid_uid(uid).alias("uid"), S.frames(frames).alias("frames"))


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a catalog with every kind of record and issue."""
    n, user = F.col("event_id"), F.col("user_id")
    media = F.when(n % 7 == 0, "raster").when(n % 11 == 0, "unsupported").when(n % 13 == 0, "unavailable").otherwise("dicom")
    hashed = media.isin("raster", "dicom") & (n % 17 != 0)
    parsed = (media == "dicom") & (n % 23 != 0)
    uid = lambda name, *parts: F.when(parsed & (n % 29 != 0), F.sha2(F.concat_ws("|", F.lit(name), *[p.cast("string") for p in parts]), 256))
    status = F.when(parsed, S.patient_id_status(_patient_id()))
    return _catalog(
        _read(spark, sf_dir, "events"),
        "event_id",
        _padded("event_id"),
        source_namespace=F.col("event_type"),
        media_type=media,
        access_issue=F.when(media == "unavailable", "symlink_not_followed"),
        file_sha256=F.when(hashed, F.sha2(F.concat_ws("|", user.cast("string"), F.col("event_type")), 256)),
        hash_failed=media.isin("raster", "dicom") & (n % 17 == 0),
        parse_error=F.when((media == "dicom") & (n % 23 == 0), "dicom_parse_failed"),
        patient_id_status=status,
        patient_group_token=F.when(status == "usable", F.sha2(F.concat_ws("|", "event_type", _patient_id()), 256)),
        study_uid_token=uid("study", user, n % 3),
        series_uid_token=uid("series", user, n % 5),
        sop_uid_token=uid("sop", n),
        modality=F.when(parsed, F.when(user % 5 == 0, None).when(user % 5 == 1, "CT").otherwise("DX")),
        number_of_frames=F.when(parsed & (n % 19 == 0), F.lit(3).cast("long")),
    )


def q_catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage_counts(mixed_records(spark, sf_dir))


def q_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.issue_counts(mixed_records(spark, sf_dir))


def q_detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = E.detector_coverage(mixed_records(spark, sf_dir), RULES)
    return covered.select("detector_id", "eligible_records", "evaluated_records", "unavailable_records", F.array_join("eligible_splits", "|").alias("eligible_splits"), F.array_join("evaluated_splits", "|").alias("evaluated_splits"))


def q_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reason_counts(mixed_records(spark, sf_dir), RULES)


def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics rolled up by severity, code and message."""
    told = diagnostics_frame(mixed_records(spark, sf_dir).withColumn("alias", F.col("path")))
    return told.groupBy("severity", "code", "message").agg(F.count("*").alias("occurrences"))


def q_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules over the mixed catalog, in one scan: findings by rule and by splits."""
    found = E.findings(mixed_records(spark, sf_dir).withColumn("alias", F.col("path")), RULES, SPLITS)
    return found.groupBy("rule_id", "category", "evidence_strength", F.array_join("splits", "|").alias("splits")).agg(F.count("*").alias("findings"), F.sum(F.size("record_aliases")).alias("records"))


_WHOLE = "media_type = 'dicom' AND parse_error IS NULL AND patient_id_status = 'usable' AND sop_uid_token IS NOT NULL AND modality = 'DX' AND number_of_frames IS NULL"
#: Parts of the mixed catalog and rules that lead to each outcome: (name, records, rules, whether something broke).
_POLICY_CASES = [
    ("mixed", "TRUE", [r.rule_id for r in RULES], False),
    ("one_split", "split = 'train'", [r.rule_id for r in RULES], False),
    ("nothing", "FALSE", [r.rule_id for r in RULES], False),
    ("whole", _WHOLE, ["ML104"], False),
    ("copies", "media_type = 'raster' AND file_sha256 IS NOT NULL", ["ML001"], False),
    ("gaps", f"({_WHOLE}) OR media_type = 'unsupported'", ["ML104"], False),
    ("not_comparable", "media_type = 'raster'", ["ML104"], False),
    ("broken", "split = 'test'", ["ML001"], True),
]


def q_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of parts of the mixed catalog, one for each way that the decision can go."""
    catalog = mixed_records(spark, sf_dir).withColumn("alias", F.col("path")).persist(StorageLevel.MEMORY_AND_DISK)

    def outcome(case: tuple) -> tuple:
        name, part, rule_ids, broke = case
        records, rules = catalog.where(part), [BY_ID[i] for i in rule_ids]
        detectors = [r.asDict() for r in E.detector_coverage(records, rules).collect()]
        found = conservative(len(E.findings(records, rules, SPLITS).select("rule_id").take(1)), C.coverage(records, SPLITS), detectors, operational_error=broke)
        return name, found.finding_status, found.coverage_status, found.audit_state, found.exit_code

    catalog.count()  # kept before the cases, which run side by side, read it
    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(outcome, _POLICY_CASES))
    catalog.unpersist()
    return spark.createDataFrame(out, "case string, finding_status string, coverage_status string, audit_state string, exit_code int")


QUERIES: dict[str, Query] = {
    name: value
    for name, value in list(globals().items())
    if name.startswith("q_") and callable(value)
}

_SPLIT = "CASE WHEN {0} % 10 < 8 THEN 'train' WHEN {0} % 10 = 8 THEN 'validation' ELSE 'test' END"


def _alias_sql(source: str) -> str:
    """CTEs `r` and `a`: records, and records with aliases."""
    return f"""r AS ({source}),
        a AS (
            SELECT *, 'record-' || lpad(CAST(row_number() OVER (ORDER BY lower(split), split, lower(ns), ns, path, ord) AS VARCHAR), CAST(greatest(6, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS alias
            FROM r
        )"""


def _findings_sql(source: str, rule_id: str) -> str:
    rule = BY_ID[rule_id]
    before, middle, after = rule.observed.split("%d")
    return f"""
        WITH {_alias_sql(source)},
        g AS (
            SELECT string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits, count(*) AS records,
                   string_agg(alias, chr(31) ORDER BY alias) AS joined
            FROM a WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT split) >= 2
        )
        SELECT '{rule_id}' AS rule_id, 'component-' || substr(sha256('{rule_id}' || chr(31) || joined), 1, 16) AS component_id, splits,
               CAST(records AS BIGINT) AS records, replace(joined, chr(31), ',') AS record_aliases,
               '{before}' || records || '{middle}' || n_splits || '{after}' AS observed_fact
        FROM g
    """


def _records_sql(table: str, number: str, key: str, ns: str = "'local'", path: str | None = None, split: str | None = None) -> str:
    path = path or f"lpad(CAST({number} AS VARCHAR), 12, '0')"
    return f"SELECT {number} AS ord, {split or _SPLIT.format(number)} AS split, {ns} AS ns, {path} AS path, {key} AS key FROM {table}"


def _lineitem_sql(rule_id: str, *keys: str) -> str:
    path = " || '-' || ".join(f"lpad(CAST({k} AS VARCHAR), 12, '0')" for k in ("l_orderkey", "l_linenumber", "l_suppkey"))
    return _findings_sql(_records_sql("lineitem", "l_partkey", " || '.' || ".join(f"CAST({k} AS VARCHAR)" for k in keys), path=path), rule_id)


_PID = "CASE user_id % 20 WHEN 0 THEN NULL WHEN 1 THEN 'Anon' WHEN 2 THEN '00-0' WHEN 3 THEN 'x_x' WHEN 4 THEN '---' ELSE 'P-' || user_id END"
_STATUS = "CASE user_id % 20 WHEN 0 THEN 'missing' WHEN 1 THEN 'dummy' WHEN 2 THEN 'dummy' WHEN 3 THEN 'dummy' ELSE 'usable' END"
_MIXED = f"""
    base AS (
        SELECT *, {_SPLIT.format("event_id")} AS split,
               CASE WHEN event_id % 7 = 0 THEN 'raster' WHEN event_id % 11 = 0 THEN 'unsupported' WHEN event_id % 13 = 0 THEN 'unavailable' ELSE 'dicom' END AS media
        FROM events
    ),
    flags AS (
        SELECT *, media IN ('raster', 'dicom') AS supported, media IN ('raster', 'dicom') AND event_id % 17 <> 0 AS hashed,
               media = 'dicom' AND event_id % 23 <> 0 AS parsed FROM base
    ),
    m AS (
        SELECT *, CASE WHEN hashed THEN user_id || '|' || event_type END AS k001,
               CASE WHEN parsed THEN {_STATUS} END AS status,
               CASE WHEN parsed AND {_STATUS} = 'usable' THEN event_type || '|' || ({_PID}) END AS k101,
               CASE WHEN parsed AND event_id % 29 <> 0 THEN user_id || '|' || event_id % 3 END AS k102,
               CASE WHEN parsed AND event_id % 29 <> 0 THEN user_id || '|' || event_id % 5 END AS k103,
               CASE WHEN parsed AND event_id % 29 <> 0 THEN CAST(event_id AS VARCHAR) END AS k104,
               CASE WHEN parsed THEN CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CT' ELSE 'DX' END END AS modality,
               parsed AND event_id % 19 = 0 AS multiframe
        FROM flags
    ),
    issues AS (
        SELECT event_id, 'unreadable' AS category, 'symlink_not_followed' AS code FROM m WHERE media = 'unavailable'
        UNION ALL SELECT event_id, 'unsupported', 'unsupported_file_type' FROM m WHERE media = 'unsupported'
        UNION ALL SELECT event_id, 'unreadable', 'file_hash_failed' FROM m WHERE supported AND NOT hashed
        UNION ALL SELECT event_id, 'unreadable', 'dicom_parse_failed' FROM m WHERE media = 'dicom' AND NOT parsed
        UNION ALL SELECT event_id, 'metadata_unavailable', 'patient_id_' || status FROM m WHERE status IN ('missing', 'dummy')
        UNION ALL SELECT event_id, 'outside_primary_profile', 'dicom_multiframe_inventory' FROM m WHERE multiframe
        UNION ALL SELECT event_id, 'outside_primary_profile', 'dicom_modality_missing' FROM m WHERE parsed AND modality IS NULL
        UNION ALL SELECT event_id, 'outside_primary_profile', 'dicom_modality_outside_primary_profile' FROM m WHERE modality = 'CT'
    )
"""
_EACH_RULE = [("ML001", "supported", "k001"), ("ML101", "media = 'dicom'", "k101"), ("ML102", "media = 'dicom'", "k102"), ("ML103", "media = 'dicom'", "k103"), ("ML104", "media = 'dicom'", "k104")]


def _messages_sql() -> str:
    from splitaudit.operators.rules import MESSAGES

    return ", ".join("('{}', '{}')".format(c, t.replace("'", "''")) for c, t in MESSAGES.items())


def _case_sql(part: str, rule_ids: list[str]) -> str:
    """What the policy looks at, of a part of the mixed catalog: findings, splits and gaps."""
    for name, own in (("media_type", "media"), ("parse_error IS NULL", "parsed"), ("patient_id_status", "status"), ("sop_uid_token", "k104"), ("number_of_frames IS NULL", "NOT multiframe"), ("file_sha256", "k001")):
        part = part.replace(name, own)
    rules = [(e, k) for r, e, k in _EACH_RULE if r in rule_ids]
    found = " + ".join(f"(SELECT count(*) FROM (SELECT 1 FROM p WHERE {e} AND {k} IS NOT NULL GROUP BY {k} HAVING count(DISTINCT split) >= 2))" for e, k in rules)
    comparable = " + ".join(f"(SELECT CAST(count(DISTINCT split) >= 2 AS INT) FROM p WHERE {e} AND {k} IS NOT NULL)" for e, k in rules)
    missing = " + ".join(f"count_if({e} AND {k} IS NULL)" for e, k in rules)
    gap = lambda category: f"(SELECT count(DISTINCT event_id) FROM issues JOIN p USING (event_id) WHERE category = '{category}')"
    return f"""WITH p AS (SELECT * FROM m WHERE {part})
        SELECT count(*) AS records, count(DISTINCT split) AS populated, {found} AS findings, {comparable} AS comparable, {missing} AS unavailable,
               {gap("unsupported")} AS unsupported, {gap("unreadable")} AS unreadable, {gap("outside_primary_profile")} AS outside
        FROM p"""


ORACLES: dict[str, str] = {
    "q_exact_content": _findings_sql(_records_sql("documents", "doc_id", "sha256(text)", "source"), "ML001"),
    "q_aliases": f"WITH {_alias_sql(_records_sql('documents', 'doc_id', 'NULL', 'source'))} SELECT ord AS doc_id, alias, split, ns AS source_namespace FROM a",
    "q_scoped_group": _findings_sql(_records_sql("orders", "o_orderkey", "o_orderpriority || chr(31) || o_custkey", "o_orderpriority"), "ML101"),
    "q_scoped_events": _findings_sql(_records_sql("events", "event_id", "event_type || chr(31) || user_id", "event_type"), "ML101"),
    "q_study": _lineitem_sql("ML102", "l_orderkey"),
    "q_series": _lineitem_sql("ML103", "l_orderkey", "l_suppkey"),
    "q_instance": _lineitem_sql("ML104", "l_orderkey", "l_linenumber"),
    "q_no_finding": " UNION ALL ".join(
        f"SELECT '{name}' AS split_by, count_if(n > 1) AS shared_keys, count_if(n_splits > 1) AS findings FROM (SELECT count(*) AS n, count(DISTINCT {_SPLIT.format(by)}) AS n_splits FROM conversations WHERE role IS NOT NULL GROUP BY role)"
        for name, by in (("turn", "turn"), ("conversation", "conv_id"))
    ),
    "q_benchmark_contam": _findings_sql(
        " UNION ALL ".join(
            f"SELECT n AS ord, '{split}' AS split, 'local' AS ns, lpad(CAST(n AS VARCHAR), 12, '0') || '-' || lpad(CAST(place AS VARCHAR), 12, '0') AS path, sha256(s) AS key FROM (SELECT n, place - 1 AS place, trim(x, ' ') AS s FROM (SELECT {number} AS n, unnest(string_split_regex(coalesce(text, ''), '[.\n]')) AS x, unnest(range(1, 1 + len(string_split_regex(coalesce(text, ''), '[.\n]')))) AS place FROM {table})) WHERE length(s) >= 20"
            for table, number, split in (("documents", "doc_id", "train"), ("benchmark", "item_id", "test"))
        ),
        "ML001",
    ),
    "q_media_type": """
        SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'dicom' WHEN 1 THEN 'dicom' WHEN 2 THEN 'raster' WHEN 3 THEN 'raster' WHEN 5 THEN CASE WHEN page_id % 2 = 0 THEN 'dicom' ELSE 'unsupported' END ELSE 'unsupported' END AS media_type,
               list_extract(['.dcm', '.dicom', '.png', '.tiff', '.txt', '', '.gz'], CAST(page_id % 7 + 1 AS INT)) AS suffix
        FROM pages
    """,
    "q_pid_status": f"SELECT event_id, {_STATUS} AS status FROM events",
    "q_uid_valid": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= 3 THEN '1.2.' || o_orderkey || '.0' END AS uid,
               CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 9 AS BIGINT) END AS frames
        FROM orders
    """,
    "q_catalog_coverage": f"""
        WITH {_MIXED}, c AS (
            SELECT event_id, bool_or(category = 'outside_primary_profile') AS outside, bool_or(category = 'unreadable') AS bad FROM issues GROUP BY event_id
        )
        SELECT count(DISTINCT split) AS populated_split_count, count(DISTINCT CASE WHEN hashed OR parsed THEN split END) AS evaluable_split_count,
               count(*) AS discovered, count_if(supported) AS supported, count_if(hashed) AS hashed, count_if(media = 'dicom') AS dicom_candidates,
               count_if(parsed) AS dicom_parsed, count_if(parsed AND (k101 IS NULL OR k102 IS NULL OR k103 IS NULL OR k104 IS NULL)) AS dicom_identity_incomplete,
               count_if(coalesce(outside, FALSE)) AS outside_primary_profile, count_if(media = 'unsupported') AS unsupported, count_if(coalesce(bad, FALSE)) AS unreadable
        FROM m LEFT JOIN c USING (event_id)
    """,
    "q_issue_counts": f'WITH {_MIXED} SELECT code, count(*) AS "count" FROM issues GROUP BY code',
    "q_detector_coverage": f"WITH {_MIXED} "
    + " UNION ALL ".join(
        f"SELECT '{r}' AS detector_id, count_if({e}) AS eligible_records, count_if({e} AND {k} IS NOT NULL) AS evaluated_records, count_if({e} AND {k} IS NULL) AS unavailable_records, coalesce(string_agg(DISTINCT split, '|' ORDER BY split) FILTER ({e}), '') AS eligible_splits, coalesce(string_agg(DISTINCT split, '|' ORDER BY split) FILTER ({e} AND {k} IS NOT NULL), '') AS evaluated_splits FROM m"
        for r, e, k in _EACH_RULE
    ),
    "q_reason_counts": f"WITH {_MIXED} SELECT 'ML001' AS detector_id, code AS reason, count(*) AS \"count\" FROM issues JOIN m USING (event_id) WHERE supported AND k001 IS NULL AND category = 'unreadable' GROUP BY code"
    + "".join(
        f" UNION ALL SELECT '{r}', CASE WHEN NOT parsed THEN 'dicom_metadata_unavailable' ELSE {why} END AS reason, count(*) FROM m WHERE media = 'dicom' AND {k} IS NULL GROUP BY reason"
        for r, k, why in [("ML101", "k101", "'patient_id_' || status"), *[(r, k, "'identifier_missing_or_invalid'") for r, _, k in _EACH_RULE[2:]]]
    ),
    "q_diagnostics": f"WITH {_MIXED}, t(code, message) AS (VALUES {_messages_sql()}) SELECT 'warning' AS severity, code, message, count(*) AS occurrences FROM issues JOIN t USING (code) GROUP BY code, message",
    "q_all_findings": f"WITH {_MIXED}, g AS ("
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, '{BY_ID[r].category}' AS category, '{BY_ID[r].strength}' AS evidence_strength, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) AS n FROM m WHERE {e} AND {k} IS NOT NULL GROUP BY {k} HAVING count(DISTINCT split) >= 2"
        for r, e, k in _EACH_RULE
    )
    + ") SELECT rule_id, category, evidence_strength, splits, count(*) AS findings, CAST(sum(n) AS BIGINT) AS records FROM g GROUP BY ALL",
    "q_policy": f"WITH {_MIXED}, "
    + ", ".join(f"case_{name} AS ({_case_sql(part, rule_ids)})" for name, part, rule_ids, _ in _POLICY_CASES)
    + """, told AS ("""
    + " UNION ALL ".join(f"SELECT '{name}' AS name, {broke} AS broke, * FROM case_{name}" for name, _, _, broke in _POLICY_CASES)
    + """), seen AS (
            SELECT *, CASE WHEN broke THEN 'operational_error' WHEN records = 0 OR comparable = 0 THEN 'inconclusive'
                           WHEN populated < 3 OR unsupported + unreadable + outside + unavailable > 0 THEN 'partial' ELSE 'complete' END AS coverage_status
            FROM told
        )
        SELECT name AS "case", CASE WHEN findings > 0 THEN 'potential_risk_detected' ELSE 'no_findings' END AS finding_status, coverage_status,
               CASE WHEN coverage_status <> 'complete' THEN coverage_status WHEN findings > 0 THEN 'complete_with_findings' ELSE 'complete_no_findings' END AS audit_state,
               CAST(CASE WHEN broke THEN 2 WHEN findings > 0 THEN 1 WHEN coverage_status = 'complete' THEN 0 ELSE 3 END AS INTEGER) AS exit_code
        FROM seen""",
}
