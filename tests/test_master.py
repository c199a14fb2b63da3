import os

from siftwire.operators import master

SCHEMA = "atomic_site_id string, name string, n long"


def table(spark, ids, mark="a"):
    return spark.createDataFrame([(str(i), f"{mark}{i}", i) for i in ids], SCHEMA)


def rows(df):
    return {r["atomic_site_id"]: r["name"] for r in df.collect()}


def test_a_small_change_rewrites_only_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "master")
    assert master.version(spark, folder) == 0
    assert master.create(table(spark, range(1000)), folder, buckets=32) == 1
    few = [7, 130, 131, 5000]
    assert master.upsert(table(spark, few, "b"), folder) == 2
    buckets = {r["bucket"] for r in master._with_bucket(table(spark, few), "atomic_site_id", 32).collect()}
    assert {int(x.split("=")[1]) for x in os.listdir(f"{folder}/data/v=2") if x.startswith("bucket=")} == buckets and len(buckets) < 5
    want = {str(i): f"a{i}" for i in range(1000)} | {str(i): f"b{i}" for i in few}
    assert rows(master.read(spark, folder)) == want and master.read(spark, folder).count() == 1001
    assert rows(master.read(spark, folder, 1)) == {str(i): f"a{i}" for i in range(1000)}
    # What is there already makes no version, among other rows it touches nothing.
    assert master.upsert(table(spark, few, "b"), folder) == 2
    assert master.upsert(table(spark, few, "b").unionByName(table(spark, [9], "c")), folder) == 3
    assert len([x for x in os.listdir(f"{folder}/data/v=3") if x.startswith("bucket=")]) == 1
    assert rows(master.read(spark, folder)) == want | {"9": "c9"}


def test_a_change_that_fails_is_not_there(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "master")
    master.create(table(spark, range(50)), folder, buckets=4)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(master, "_publish", fail)
        try:
            master.upsert(table(spark, range(20), "lost"), folder)
        except RuntimeError:
            pass
    assert os.path.exists(f"{folder}/data/v=2") and master.version(spark, folder) == 1
    assert rows(master.read(spark, folder)) == {str(i): f"a{i}" for i in range(50)}
    assert master.upsert(table(spark, [3], "b"), folder) == 2
    assert rows(master.read(spark, folder)) == {str(i): f"a{i}" for i in range(50)} | {"3": "b3"}


def test_empty_tables_and_nulls(spark, tmp_path):
    folder = str(tmp_path / "master")
    master.create(table(spark, []), folder, buckets=4)
    assert master.read(spark, folder).count() == 0 and master.upsert(table(spark, []), folder) == 1
    one = spark.createDataFrame([("1", None, None)], SCHEMA)
    assert master.upsert(one, folder) == 2 and master.upsert(one, folder) == 2
    assert master.read(spark, folder).collect() == one.collect()
