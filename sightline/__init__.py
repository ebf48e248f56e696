"""Sightline: interval, detection and sensor analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python workers need no copy of this package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
