"""The folder that executors share."""

import pytest

from lodestone import session


class Context:
    """A session that runs elsewhere and names no folder."""

    master = "spark://host:7077"

    def __getattr__(self, name):
        return lambda *a: self

    def get(self, *a):
        return None

    def isDefined(self):  # noqa: N802
        return False


def test_a_cluster_without_a_shared_folder_is_refused():
    spark = Context()
    spark.sparkContext = spark.conf = spark
    spark._jsc = Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(spark)


def test_a_local_session_has_a_folder_of_its_own(spark):
    at = session.shared_folder(spark)
    assert at and session.shared_folder(spark) == at


def test_tables_are_dropped(spark):
    import os

    df = session.stored(spark.range(5), "numbers")
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in df.inputFiles()}
    assert os.path.isdir(folder)
    session.dropped(df)
    assert not os.path.exists(folder)
