"""Operators of a training-data pipeline: cleaning, dedup, tokenising, sharding.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are pickled by value, so executors need no copy of it.
"""

from pyspark import cloudpickle

import sys as _sys

cloudpickle.register_pickle_by_value(_sys.modules[__name__])
