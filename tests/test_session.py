"""Session helpers: checkpoint folder from the session, spread(), cut_lineage()."""

from hashsieve.session import checkpoint_dir, cut_lineage, scratch_path, spread


def test_checkpoint_dir_comes_from_session(spark):
    d = checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(d.rstrip("/"))
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and f"/tables/{spark.sparkContext.applicationId}/" in df.inputFiles()[0]


def test_spread_only_when_under_split(spark):
    one = spark.range(0, 100, 1, numPartitions=1)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(0, 100, 1, numPartitions=8)
    assert spread(many, 4).rdd.getNumPartitions() == 8
