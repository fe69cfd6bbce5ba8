"""codexmill: a Spark-native engine for versioned knowledge graphs and hybrid retrieval."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
