"""Weftline: a Spark-first engine for code-structure facts and corpus pipelines.

Functions that run in Python workers travel by value, so that executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
