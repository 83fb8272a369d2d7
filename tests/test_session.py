"""Scratch space comes from the session's checkpoint folder."""

from dhvani.session import ensure_checkpoint_dir, scratch_path


def test_scratch_under_checkpoint_dir(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d
    p1, p2 = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert p1.startswith(d.rstrip("/") + "/dhvani/x-") and p1 != p2
