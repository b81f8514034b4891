"""Fact-ledger jobs on Spark: DataFrame-in, DataFrame-out functions for curating large catalogues."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so that the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
