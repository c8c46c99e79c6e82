"""A store of jobs' tables: whole versions, visible all at once.

Saving a batch writes each of its tables to a folder of a new version, in buckets of job ids, then the ids of its jobs,
and last a manifest of one row. A reader looks for manifests only: a version without one, because a task or the driver
failed, doesn't exist, and what was there before stays readable. Of a job the newest version that names it counts, with
the tables of that version and no others, so a job that is saved again with fewer tables or rows reads back exactly.
Nothing that was written is changed; versions are ordered by the time at which their saving began.

A path that holds no store raises, as Spark does; a job that no version names gives no tables; a table without rows for
a job gives an empty one. Null job ids can't be saved.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arboris.functions.text import safe_name

#: Folders of a table; a job's rows are in one of them.
BUCKETS = 64


def bucket_of(job_id: Column) -> Column:
    return F.pmod(F.crc32(job_id.cast("binary")), F.lit(BUCKETS)).cast("int")


def new_version() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def save(tables: dict[str, DataFrame], jobs: DataFrame, path: str) -> str:
    """Write a version of all ``tables``, each with a job_id, for the ids in ``jobs``; its name."""
    version = new_version()
    spark = jobs.sparkSession
    ids = jobs.select(F.coalesce("job_id", F.raise_error(F.lit("a job without an id can't be saved"))).alias("job_id")).distinct()
    for folder, df in [*((f"data/{version}/{n}", df) for n, df in tables.items()), (f"jobs/version={version}", ids)]:
        df.withColumn("_bucket", bucket_of(F.col("job_id"))).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    manifest = spark.createDataFrame([(version, {n: df.schema.json() for n, df in tables.items()})], "version string, tables map<string,string>")
    manifest.coalesce(1).write.parquet(f"{path}/manifests/{version}")
    return version


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """The saved versions, newest first: a row for each batch."""
    return [r.asDict() for r in spark.read.parquet(f"{path}/manifests/*").orderBy(F.desc("version")).collect()]


def _read(spark: SparkSession, base: str, folders: list[str], schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", base).parquet(*folders)


def load(spark: SparkSession, path: str, job_id: str) -> dict[str, DataFrame]:
    """The tables of a job's newest version; only the job's bucket is read."""
    manifests = _manifests(spark, path)
    ids = T.StructType().add("job_id", T.StringType()).add("version", T.StringType())
    own = (F.col("_bucket") == bucket_of(F.lit(job_id))) & (F.col("job_id") == job_id)
    version = _read(spark, f"{path}/jobs", [f"{path}/jobs/version={m['version']}" for m in manifests], ids).where(own).agg(F.max("version")).first()[0]
    if version is None:
        return {}
    tables = next(m["tables"] for m in manifests if m["version"] == version)
    return {n: _read(spark, f"{path}/data/{version}/{n}", [f"{path}/data/{version}/{n}"], T.StructType.fromJson(json.loads(s))).where(own).drop("_bucket") for n, s in tables.items()}


def artifacts(contents: DataFrame) -> DataFrame:
    """job_id, name, media_type, size_bytes, sha256 and content of ``contents`` (job_id, name, media_type, content) as a table
    to save with a job: names are made safe for folders, and one of which nothing is left fails the save."""
    raw = F.coalesce(F.col("content"), F.lit("")).cast("binary")
    return contents.select("job_id", safe_name(F.col("name")).alias("name"), "media_type", F.octet_length(raw).cast("long").alias("size_bytes"), F.sha2(raw, 256).alias("sha256"), F.coalesce("content", F.lit("")).alias("content"))


def append(rows: DataFrame, path: str) -> None:
    """Append rows that know when their writer began; nothing that was written is ever changed."""
    rows.withColumn("_version", F.lit(new_version())).write.mode("append").parquet(path)


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """Of appended rows of one ``key`` that of the first writer: two writers of one key leave one row, whoever ends first."""
    names = [c for c in rows.columns if c != "_version"]
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*names), "_version").alias("x"))
    return kept.select(*(F.col("x")[c].alias(c) for c in names))
