import pytest

from inkwell.llm import common


class Session:
    """As much of a session as the folder's choice reads."""

    def __init__(self, **conf):
        self.values = {k.replace("_", "."): v for k, v in conf.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session(spark_master="spark://host:7077"))
    assert common.shared_dir(Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    local = Session(spark_master="local[2]")
    assert common.shared_dir(local) == common.shared_dir(local) and common.shared_dir(local).startswith("file://")


def test_fresh_names():
    assert common.fresh(["a", "__n"], "__n", "__t") == ["__n_", "__t"]


def test_batches_are_bounded(spark):
    rows, bytes_ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, bytes_)}
    try:
        for said, want in (("64m", f"{common.BATCH_BYTES}b"), ("1048576b", "1048576b"), ("4mb", "4mb"), ("1g", f"{common.BATCH_BYTES}b")):
            spark.conf.set(bytes_, said)
            common.bound_batches(spark)
            assert spark.conf.get(bytes_) == want or (said == "4mb" and spark.conf.get(bytes_) == "4194304b")
        assert int(spark.conf.get(rows)) <= common.BATCH_ROWS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
