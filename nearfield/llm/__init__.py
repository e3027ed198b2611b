"""Operators for preparing training text at scale.

Every operator takes and returns DataFrames; ``queries.py`` holds the thin
queries over the standard tables.  Nothing outside this package imports it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors may not have the repository on their path: ship the code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
