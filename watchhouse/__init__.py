"""Watchhouse: security-log analytics as PySpark jobs.

Raw firewall, Windows and Linux logs become one wide event table; the table is
enriched, matched against correlation rules over look-back windows, merged into
de-duplicated alerts and summarised in dashboard and compliance reports.  Every
step is a DataFrame -> DataFrame function that works in batch and, where noted,
under Structured Streaming.  No function reads the wall clock: callers pass
``as_of``.
"""

import sys

from pyspark import cloudpickle

from watchhouse.session import configure, shared_dir

__all__ = ["configure", "shared_dir"]

# The few Python functions that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
