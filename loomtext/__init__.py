"""Document text extraction and text-corpus operators as Spark DataFrame code."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
