"""Double-perspective ledger analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
