"""A Spark-first engine for ledgers that are fed by many sources."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel by value, so a cluster needs no copy of this package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
