"""Wearable-sensor analytics as table-in / table-out PySpark operators.

Functions that run inside Python workers are shipped by value, so executors
need numpy, pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
