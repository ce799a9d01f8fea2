"""Retail inventory and demand analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
