"""courtstats: leaderboards and event-sequence analytics as Spark DataFrame plans.

Every public function takes DataFrames / Columns and returns DataFrames /
Columns.  Nothing is collected to the driver and no Python UDF is used, so
the same code runs on one season or on decades of event logs.
"""

from courtstats.session import checkpoint_dir, get_spark

__all__ = ["checkpoint_dir", "get_spark"]
