"""The shared checkpoint folder comes from the session when it is set."""

import os

from platelens.session import ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_is_reused(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == d                 # stable, never replaced
    p = scratch_path(spark, "x")
    assert p.startswith(d.rstrip("/")) and p.endswith(os.path.join("tables", "x"))


def test_defaults(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.ui.enabled") == "false"
