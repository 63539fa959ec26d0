"""Prequential (test-then-train) analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
