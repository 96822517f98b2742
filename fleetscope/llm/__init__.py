"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors then need no copy of the package on their import path.
register_pickle_by_value(sys.modules[__name__])
