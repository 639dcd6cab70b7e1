"""Operators for large training-text corpora, and the queries that apply them.

Nothing outside this folder imports it.  Functions that run in Python workers
are pickled by value, so an executor does not need this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
