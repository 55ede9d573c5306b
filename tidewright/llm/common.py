"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers that see this file system import the package wherever the driver was started.

    On a cluster without the source tree the package travels with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or already set as the checkpoint folder).

    Only where all tasks run on the driver's machine does a temporary folder of ours stand in for it;
    on a cluster a machine-local folder would lose data, so there it is an error.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        found = context._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewright-checkpoint-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it (in any case of letters)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing needs any more (an older round of an iteration)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidewright/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fold_of(doc_id: object, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts

