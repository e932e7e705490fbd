"""Training-data lineage and post-training analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
