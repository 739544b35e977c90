"""mossgrid: Spark-first analytics for multimodal question-answering benchmarks."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel to the executors by value: they need not have it
# installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
