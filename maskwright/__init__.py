"""Data-protection analytics on Spark DataFrames.

Discover personal data, mask tables and streams, run governed relational
queries with per-column provenance, count k-anonymity, and analyse query logs.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job: executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
