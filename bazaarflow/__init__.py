"""Table-in, table-out PySpark operators for building and maintaining a product catalogue."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
