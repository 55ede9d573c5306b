"""Session set-up, table loading and the tenant-scoped view of a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(app: str = "tidewright", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides any setting (dots as ``__``)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt to all cores if it comes in fewer partitions: for dear work over the rows of a small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_rows(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """Dealt by keys to partitions of about ``rows`` rows, so that a task's memory doesn't grow with the table; for plain tables, which are counted by their footers."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where all tasks run on this machine."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    path = context.getConf().get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    if not found.isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that later rounds of an iteration don't carry the earlier ones' plans.

    Unlike checkpoint() this gives the rows' true size: a checkpoint keeps the estimate of the plan that made it, and
    estimates of joins multiply from round to round until working them out takes minutes.
    """
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tenant_scope(df: DataFrame, organization: Column, organization_id: object, project: Column | None = None, project_id: object = None, super_admin: bool = False) -> DataFrame:
    """Rows of one organisation (and project); only a super admin may leave the organisation out."""
    if super_admin:
        return df
    if organization_id is None:
        raise ValueError("organization_id is required to read a tenant's table")
    df = df.where(organization == F.lit(organization_id))
    return df.where(project == F.lit(project_id)) if project is not None and project_id is not None else df


def not_deleted(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    """Rows that are not softly deleted."""
    return df.where(F.col(deleted_at).isNull())
