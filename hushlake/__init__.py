"""Sensitive-data analytics on Spark: find, redact, gate and report on sensitive values in tables and streams."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the task, so the package does not
# have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
