"""nearfield: nearest-neighbour search and corpus preparation on Spark DataFrames.

Vectors are rows (id BIGINT, v ARRAY<DOUBLE>); neighbours are rows
(q_id BIGINT, rank INT, d_id BIGINT, dist DOUBLE), ordered by (dist, d_id).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors may not have the repository on their path: ship the code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
