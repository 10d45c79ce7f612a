"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, so that long texts can't fill a worker; plans read this when they run, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "prosegauge_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str
) -> DataFrame:
    """mapInArrow of a function that make() builds once a task; it returns columns by name."""
    bounded_batches(df.sparkSession)
    ship_package(df.sparkSession)
    names = [part.split()[0] for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)],
                    names=[n.strip("`") for n in names],
                )

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it in other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(id_column: str = "doc_id"):
    """True for the fifth of the ids that no label may be learnt from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of this machine's if no other takes part, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = context.getConf().get("spark.checkpoint.dir")
        if not place and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that the driver and all executors share")
        context.setCheckpointDir(place or "/tmp/checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with files that all executors share (spark.checkpoint.dir)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids up to which a semi-join broadcasts them; 16 MB of longs.
BROADCAST_IDS = 2_000_000


def having_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is among ids: by broadcast while these are few, else by a shuffled join."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")
