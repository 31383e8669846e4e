"""corpusflow: set-at-a-time document retrieval and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions shipped to Python workers travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
