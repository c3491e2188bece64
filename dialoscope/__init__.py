"""Dialoscope: evaluation analytics for conversational agents on Spark.

Everything is a ``DataFrame -> DataFrame`` function built from Column
expressions.  See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

from dialoscope.session import build_session

# functions and stateful processors go to the workers by value: the library need not be on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
