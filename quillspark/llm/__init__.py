"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions of this subpackage are shipped to Spark's Python workers by value, so a job needs no
installation of the package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
