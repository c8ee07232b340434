import pytest

from postmill import session


class Conf(dict):
    pass


class FakeContext:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"


class FakeSession:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = FakeContext(master), Conf(conf)


def test_the_named_folder_is_used():
    spark = FakeSession("spark://host:1", **{"spark.checkpoint.dir": "hdfs://shared/ck/"})
    assert session.shared_dir(spark) == "hdfs://shared/ck/app-1"


def test_a_cluster_needs_a_named_folder():
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("spark://host:1"))


def test_tables_are_written_and_read_back(spark):
    df = spark.range(5).selectExpr("id", "array(id) as a")
    back = session.materialise(df)
    assert back.schema.names == ["id", "a"] and back.count() == 5
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
