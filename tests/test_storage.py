import os

import pytest

from strandline.plans import storage


class Cluster:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.checkpoint_dir(Cluster)


def test_settled_tables_are_read_again_and_cleaned_up(spark):
    with storage.cleaned(spark):
        a = storage.settle(spark.range(5))
        at = a._settled_at
        b = storage.settle(a.selectExpr("id + 1 as id"), replaces=a)
        assert not os.path.exists(at.removeprefix("file:")) and os.path.exists(b._settled_at.removeprefix("file:"))
        assert sorted(r["id"] for r in b.collect()) == [1, 2, 3, 4, 5]
    assert not os.path.exists(b._settled_at.removeprefix("file:"))
    kept = storage.settle(spark.range(3))
    assert kept.count() == 3 and os.path.exists(kept._settled_at.removeprefix("file:"))
