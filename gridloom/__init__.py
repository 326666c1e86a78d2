"""Tabular-file analytics on PySpark.

Functions of this package travel to executors by value, so a cluster needs no
copy of the package on its workers.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
