"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers travel by value, so executors need the third-party libraries
but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
