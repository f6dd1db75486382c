"""Spatial field analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the workers by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
