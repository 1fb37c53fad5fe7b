import pytest

from tesselune import storage


class Session:
    """A session that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    def __init__(self, master):
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_folders_without_a_setting():
    one, two = (storage.shared_dir(Session("local[2]")) for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="must name a folder"):
        storage.shared_dir(Session("spark://host:7077"))


def test_tables_of_a_workspace_go(spark):
    with storage.workspace(spark) as path:
        inner = storage.stored(spark.range(5))
        assert inner.count() == 5 and inner.inputFiles()[0].removeprefix("file://").startswith(path.removeprefix("file:"))
        kept = storage.stored(spark.range(7), path + "-kept")
    assert kept.count() == 7
    with pytest.raises(Exception):
        inner.count()
    storage.remove(spark, path + "-kept")
