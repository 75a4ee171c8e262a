"""tessera: catalogue queries, record linkage and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
