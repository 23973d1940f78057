"""placelens: review-based place search, ranking and reporting as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
