"""Execution-trace analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame (or Column to Column), so a
pipeline is ordinary PySpark and Catalyst plans it as one query.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
