"""Session helpers: batch bounds are set once and kept, a shared folder is asked for on a cluster."""

from types import SimpleNamespace

import pytest

from folioweave import session


class Conf(dict):
    @property
    def getAll(self):
        return self

    def set(self, name, value):
        self[name] = value


def fake(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master, applicationId="fake", addPyFile=lambda path: None))


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))
    assert session.shared_dir(fake("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    alone = fake("local[4]")
    assert session.shared_dir(alone) == session.shared_dir(alone)


def test_bounds_of_the_session_are_kept():
    name, other = session.BATCHES
    s = session.prepare(fake("local[1]", **{name: "77"}))
    assert s.conf[name] == "77" and s.conf[other] == session.BATCHES[other]
