"""A Spark-native document log: paths, registers, snapshots and a small query language on DataFrames."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
