"""Network-flow anomaly detection and telemetry analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers receive the package's functions with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
