"""PySpark-native document-to-answer analytics."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
