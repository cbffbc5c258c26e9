"""stratalane: identifier, matrix, interval and sequence analytics as composable PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get our functions by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
