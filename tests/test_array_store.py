"""The array store: what is written comes back, only what is asked for is opened, and jobs commit as a whole."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.sources.array_store import ArrayStore, file_of


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(ArrayStore)
    return str(tmp_path / "contours")


def test_round_trip(spark, store):
    os.makedirs(store)
    rows = [("a/1 é", [1.0, 2.5], [True, False], 7), ("b", [], [True], None), ("c", None, None, 3)]
    df = spark.createDataFrame(rows, "key string, f0 array<double>, voiced array<boolean>, n long")
    df.repartition(3).write.format("arrays").mode("append").save(store)
    assert sorted(os.listdir(store)) == ["a%2F1%20%C3%A9.npz", "b.npz", "c.npz"]
    got = spark.read.format("arrays").schema(df.schema).load(store)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    spark.createDataFrame([("b", [9.0])], "key string, f0 array<double>").write.format("arrays").mode("append").save(store)
    assert {r.key: r.f0 for r in got.select("key", "f0").collect()}["b"] == [9.0] and got.count() == 3
    spark.createDataFrame([("d", [9.0])], "key string, f0 array<double>").write.format("arrays").mode("overwrite").save(store)
    assert os.listdir(store) == ["d.npz"]


def test_reads_what_others_wrote(spark, store):
    os.makedirs(store)
    for k in range(5):
        np.savez_compressed(file_of(store, f"p{k}"), en_f0=np.arange(k, dtype=np.float32), es_f0=np.ones(2))
    got = spark.read.format("arrays").schema("key string, en_f0 array<double>").option("files", 2).load(store)
    assert got.rdd.getNumPartitions() == 3
    assert {r.key: r.en_f0 for r in got.collect()} == {f"p{k}": [float(i) for i in range(k)] for k in range(5)}
    assert [r.key for r in got.where(F.col("key") == "p3").collect()] == ["p3"]


def test_other_arrays_are_not_opened(spark, store):
    """A broken array does no harm to those that don't ask for it."""
    import zipfile

    os.makedirs(store)
    with zipfile.ZipFile(file_of(store, "x"), "w") as z:
        z.writestr("broken.npy", b"no array")
        with z.open("good.npy", "w") as f:
            np.lib.format.write_array(f, np.array([1.0]))
    read = spark.read.format("arrays")
    assert read.schema("key string, good array<double>, missing array<double>").load(store).collect() == [("x", [1.0], None)]
    with pytest.raises(Exception, match="(?i)magic|npy"):
        read.schema("key string, broken array<double>").load(store).collect()


def test_rows_layout(spark, store):
    os.makedirs(store)
    np.savez_compressed(file_of(store, "dataset-en-es"), x=np.arange(4500.0).reshape(1500, 3), y=np.arange(1500))
    got = spark.read.format("arrays").option("layout", "rows").schema("y long, x array<double>").load(store)
    assert got.count() == 1500 and got.where("y = 1234").first().x == [3702.0, 3703.0, 3704.0]


def test_failed_jobs_leave_nothing(spark, store):
    os.makedirs(store)
    np.savez_compressed(file_of(store, "b"), v=np.zeros(1))
    for rows in ([("a", [1.0]), (None, [2.0])], [("a", [1.0]), ("a", [2.0])]):
        with pytest.raises(Exception, match="key"):
            spark.createDataFrame(rows, "key string, v array<double>").repartition(1).write.format("arrays").mode("append").save(store)
        assert os.listdir(store) == ["b.npz"]
    with pytest.raises(Exception, match="schema"):
        spark.read.format("arrays").load(store).collect()
    with pytest.raises(Exception, match="plain path"):
        spark.read.format("arrays").schema("key string").load("hdfs://x/y").collect()
