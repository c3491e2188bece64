"""Operators for training-data pipelines: deduplication, filtering, search, tokens, formatting.

Nothing outside this package imports it.  Functions that run in Python workers
are sent by value, so workers need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
