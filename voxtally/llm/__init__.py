"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions of this package that run in Spark's Python workers travel with the job, so the
executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
