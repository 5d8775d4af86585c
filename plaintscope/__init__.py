"""Customer-feedback text analytics on Spark: DataFrame in, DataFrame out."""

from plaintscope.session import build_session, checkpoint_dir, small_side, spread, stage

__all__ = ["build_session", "checkpoint_dir", "small_side", "spread", "stage"]
