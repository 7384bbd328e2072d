"""webdiag: console-log rollups and computed-style audits as Spark jobs.

Every public function takes DataFrames and returns DataFrames; the work is
expressed with built-in Spark SQL functions so Catalyst plans it and
whole-stage codegen runs it. See README.md for the operator map.
"""

from webdiag.session import get_spark, checkpoint_dir, materialize

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
