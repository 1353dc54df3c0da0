"""A PySpark-native engine for document collections: pages to passages to vectors to nearest passages.

Functions of this package are shipped to Spark's Python workers by value, so executors need no installation of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
