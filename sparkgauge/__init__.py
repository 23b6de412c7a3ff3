"""sparkgauge: document-quality analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs no installed copy there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
