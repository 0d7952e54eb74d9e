import pytest

from logstrata import runtime


class Session:
    """As much of a session as the choice of the folder asks for."""

    def __init__(self, settings):
        self.settings = settings
        self.conf = self
        self.sparkContext = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value

    def getConf(self):
        return self


def test_the_named_folder_is_used():
    assert runtime.shared_dir(Session({"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["yarn", "spark://h:1", "local-cluster[2,1,512]"])
def test_a_cluster_without_a_named_folder_is_refused(master):
    with pytest.raises(ValueError):
        runtime.shared_dir(Session({"spark.master": master}))


def test_a_local_master_gets_a_temporary_folder():
    s = Session({"spark.master": "local[4]"})
    made = runtime.shared_dir(s)
    assert made.startswith("file:///") and runtime.shared_dir(s) == made


def test_written_tables_and_spread_scans(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "array(id) AS a")
    again = runtime.materialize(df, "t")
    assert again.dtypes == df.dtypes and again.count() == 10
    one = spark.range(8).coalesce(1)
    assert runtime.spread(one).rdd.getNumPartitions() == 4 and runtime.spread(spark.range(8).repartition(6)).rdd.getNumPartitions() == 6


def test_failures_that_may_pass_are_tried_again():
    waits, calls = [], []

    def call(errors):
        calls.append(1)
        if errors:
            raise OSError(errors.pop(0))
        return "done"

    assert runtime.retried(lambda e=["Status Code: 503", "SlowDown"]: call(e), sleep=waits.append) == "done"
    assert len(calls) == 3 and 0.1 <= waits[0] <= 0.11 and 0.2 <= waits[1] <= 0.22
    with pytest.raises(OSError, match="no such file"):
        runtime.retried(lambda: call(["no such file"]), sleep=waits.append)
    with pytest.raises(OSError, match="timed out"):
        runtime.retried(lambda: call(["timed out"]), sleep=waits.append)
    assert len(waits) == 4
