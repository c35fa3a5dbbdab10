"""Analytics of agent runs on Spark."""

import sys

from pyspark import cloudpickle

# Functions and data sources of this package travel to the executors by value, so that they need no
# installed copy of it and the driver may run from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
