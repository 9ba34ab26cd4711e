"""Operators that prepare large text collections for training.

Functions of this package travel to the executors by value, so that jobs run
there whether or not the package is installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
