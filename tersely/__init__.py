"""Text-redundancy analytics on Spark: documents are rows, operators are DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
