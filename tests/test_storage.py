"""Tables in the shared folder."""

from chronograft import storage


def test_keep_forget_clear(spark):
    a, b = storage.keep(spark.range(5).toDF("x"), "a"), storage.keep(spark.range(0).toDF("x"), "b")
    assert a.count() == 5 and b.count() == 0 and a.columns == ["x"]
    files = spark.read.format("binaryFile").load(storage._own_dir(spark) + "/a-*")
    assert files.count() > 0
    storage.forget(a)
    assert spark.sparkContext._jvm.java.io.File(storage._own_dir(spark).removeprefix("file://")).exists()
    kept = storage.keep(spark.range(3).toDF("x"), "c")
    assert kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    import pytest

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    from chronograft import storage

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
