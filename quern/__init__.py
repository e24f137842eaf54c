"""quern: retrieval, analytics and corpus operators as plain PySpark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so
# executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
