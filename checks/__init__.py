"""Queries over the given tables that exercise every operator, with SQL to compare with."""

import sys

from pyspark import cloudpickle

# Packing functions travel to the workers by value, wherever the session was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from checks.registry import ORACLE, QUERIES
from checks import detect, relational, evaluate, files, stored  # noqa: F401  (registration)
