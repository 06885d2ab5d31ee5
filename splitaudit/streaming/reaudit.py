"""Audits of a growing record table: each micro-batch re-audits the keys that it touches.

The audit itself is a batch computation; a stream only tells which keys to look at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from splitaudit.operators.evidence import findings
from splitaudit.operators.rules import Rule


def reaudit(stream: DataFrame, history: str, out: str, rules: list[Rule], splits: list[str], checkpoint: str) -> StreamingQuery:
    """Append each batch of catalog rows to `history` and write the findings of its keys to `out`/batch=N.

    A batch that is run again after a failure overwrites its own files, so its rows count once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        seen = spark.read.option("basePath", history).schema(batch.schema).parquet(f"{history}/batch=*")
        if len(rules) == 1:  # only keys of this batch can have changed
            new = spark.read.schema(batch.schema).parquet(f"{history}/batch={number}").select(rules[0].key).distinct()
            seen = seen.join(new, rules[0].key, "left_semi")
        findings(seen, rules, splits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
