"""Spark-native de-identification of record tables and corpus metrics."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
