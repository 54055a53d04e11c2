"""storyweft: a Spark-first library for news-story analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
