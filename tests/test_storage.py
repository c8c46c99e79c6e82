"""What a staged table leaves on disk."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from arboris import storage


def files(spark, kind="shuffle_"):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if kind in x}


def test_shuffle_files_go_when_a_table_is_staged(spark):
    before = files(spark)
    df = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum("id").alias("x")).repartition(7, "k")
    kept = storage.kept(df)
    for _ in range(50):  # they are removed in the background
        if not (left := files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(storage._CLEANUP, None) is None
    assert kept.count() == 50_000 == df.count()  # and what led to the table can still be made again
    assert all(".zstd." in x for x in kept.inputFiles())
    spark.conf.set(storage._CLEANUP, "false")
    try:
        storage.kept(df)
        assert spark.conf.get(storage._CLEANUP) == "false"
    finally:
        spark.conf.unset(storage._CLEANUP)


def staged(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(storage.shared_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()


def test_tables_on_the_way_go(spark):
    written, there = list(storage._written), staged(spark)
    base = storage.kept(spark.range(10))

    def make():
        first = storage.kept(base.withColumn("x", F.col("id") * 2))
        inner = storage.kept_alone(lambda: storage.kept(first.where("x > 4")).where("x < 12"))
        return inner.join(base, "id")

    made = storage.kept_alone(make)
    assert sorted(r["x"] for r in made.collect()) == [6, 8, 10] and base.count() == 10
    new = [p for p in storage._written if p not in written]
    assert len(new) == 2 and storage._on_the_way.get() is None  # the one it starts from and the one it leads to
    assert staged(spark) - there == {p.rsplit("/", 1)[1] for p in new}


def test_evidence_leaves_one_table(spark):
    from arboris.plans.engine import reconcile
    from arboris.profiles import BUNDLES
    from tests.trees import table

    r = reconcile(table(spark, j=("r#r[a#a,b#b]", "r#r[a#a,x#x]")), BUNDLES["dita-map-v1"])
    before = len(storage._written)
    assert r.evidence.count() == 6 and len(storage._written) == before + 1
    r.positions.count()
    before = len(storage._written)
    assert r.regions.count() > 0 and len(storage._written) == before + 1
