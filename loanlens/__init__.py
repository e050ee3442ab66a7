"""loanlens: point-in-time credit-risk analytics as Spark DataFrame operators.

Layout
------
sources/    table readers, raw-file ingest, fixture views over the driver tables
functions/  column-expression helpers (parsing, banding, row-wise stats)
operators/  snapshot, ordered prefix, metrics, stability, policy, splits,
            profiles, models -- each a function DataFrame -> DataFrame
plans/      named end-to-end queries and report queries
streaming/  optional score-monitoring stream
"""

from loanlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
