"""Registered table queries against their SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
NAMES = [n for n in entry.queries() if n.startswith("q_")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def test_every_query_has_sql():
    assert not set(NAMES) - set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = sorted(repr(sorted(r.asDict().items())) for r in entry.queries()[name](spark, str(SF)).collect())
    want = duck.sql(entry.oracle_sql()[name])
    assert got == sorted(repr(sorted(zip(want.columns, r, strict=True))) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns and os.path.isdir(entry.SMOKE_DIR)


def test_one_shuffle_decides_all_rules(spark):
    from splitaudit.operators import evidence
    from splitaudit.operators.rules import RULES
    from splitaudit.plans.tables import SPLITS, mixed_records
    from pyspark.sql import functions as F

    catalog = mixed_records(spark, str(SF)).withColumn("alias", F.col("path"))
    text = evidence._keys(catalog, RULES).groupBy("rule_id", "key").count()._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Expand" in text
    shuffled = evidence.findings(catalog.repartition(7), RULES, SPLITS)
    assert sorted(shuffled.select("component_id").collect()) == sorted(evidence.findings(catalog, RULES, SPLITS).select("component_id").collect())


def test_stream_reaudits_growing_table(spark, tmp_path):
    from splitaudit.operators.rules import RULES
    from splitaudit.streaming.reaudit import reaudit
    from splitaudit.plans.tables import SPLITS, mixed_records
    from pyspark.sql import functions as F

    catalog = mixed_records(spark, str(SF)).withColumn("alias", F.col("path"))
    catalog.where("ord % 2 = 0").write.parquet(str(tmp_path / "in"))
    catalog.where("ord % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(catalog.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    reaudit(stream, str(tmp_path / "history"), str(tmp_path / "out"), RULES[:1], SPLITS, str(tmp_path / "check")).awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert spark.read.parquet(str(last)).count() > 0
