"""Contract analytics and document-corpus operators, declared as Spark DataFrame plans.

Functions that run in Python workers travel by value, so executors need no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
