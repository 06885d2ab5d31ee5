"""Whole rows dealt by key as compressed record batches: shuffles of texts at a third of their size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs as B
from . import tokens as K
from .common import fresh, tidy

NULL_ID = np.iinfo(np.int64).max
ROWS = 7
#: Rows in one block.
BLOCK_ROWS = 256


def by_key(ids: np.ndarray, groups: int) -> np.ndarray:
    return (K.mix(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _send_batch(sender: B.Sender, batch: pa.RecordBatch, number: str, groups: int) -> None:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
    for part, at in B.split_by(by_key(batch.column(number).to_numpy(), groups), groups):
        for lo in range(0, len(at), BLOCK_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch.take(pa.array(at[lo : lo + BLOCK_ROWS])))
            sender.add(part, ROWS, sink.getvalue().to_pybytes())


def send_rows(rows: DataFrame, number: str, groups: int) -> DataFrame:
    """Blocks (part, kind ROWS, blob) of the rows, dealt by a long column without nulls."""

    def run(batches):
        sender = B.Sender()
        for batch in batches:
            _send_batch(sender, batch, number, groups)
            yield from sender.full()
        yield from sender.rest()

    return rows.mapInArrow(tidy(run), B.SCHEMA)


def cut_rows(number: str):
    """Deals blocks of rows to groups, for `blobs.by_group`."""

    def run(sender: B.Sender, kind: int, groups: int, blobs: list[bytes]) -> None:
        for batch in pa.concat_tables(map(read_rows, blobs)).combine_chunks().to_batches():
            _send_batch(sender, batch, number, groups)

    return run


def read_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """`docs` with a long column that holds the key, nulls as the greatest long."""
    number = fresh(docs, "row_key")
    return docs.withColumn(number, F.coalesce(F.col(key).cast("long"), F.lit(int(NULL_ID)))), number
