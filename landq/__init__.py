"""landq: land-record analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
