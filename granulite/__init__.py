"""Visual-inspection and machine-telemetry analytics for Spark."""

import sys

from pyspark import cloudpickle

# helpers that run in Python workers travel with the job; executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
