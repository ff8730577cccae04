"""Spark-native XML validation and XPath analytics, with training-data operators in ``llm``."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
