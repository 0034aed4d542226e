"""zephyrgrid: time-series operators for regional weather and electricity data on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small solver functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
