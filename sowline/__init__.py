"""sowline: batch analytics for seed-operations data, written as Spark DataFrame functions.

Every operator is a plain function ``DataFrame -> DataFrame`` (column names are
parameters) built from Spark SQL functions, windows and joins, so Catalyst can
prune, push down and plan the shuffles.  ``sowline.plans`` maps the operators
onto the driver tables.
"""

from sowline.session import build_session, checkpoint_dir, materialize

__all__ = ["build_session", "checkpoint_dir", "materialize"]
