"""postlens: posting-feed analytics expressed as Spark DataFrame and Column code."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers travel to executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
