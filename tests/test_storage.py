from types import SimpleNamespace

import pytest

from routeloom import storage


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_named_folder_is_used():
    assert storage.shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"


def test_only_a_local_session_may_go_without():
    folder = storage.shared_folder(session("local[2]"))
    assert folder.startswith("/tmp/run-") and storage.shared_folder(session("local[2]")) == folder
    with pytest.raises(ValueError):
        storage.shared_folder(session("yarn"))


def test_stored_rows_come_back(spark):
    df = spark.range(5).selectExpr("id", "array(id, id + 1) AS a")
    back = storage.stored(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
