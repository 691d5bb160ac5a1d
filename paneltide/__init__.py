"""paneltide: time-series panel analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
