"""Document-intelligence analytics as plain DataFrame-in, DataFrame-out Spark operators."""

import sys

from pyspark import cloudpickle

# Workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
