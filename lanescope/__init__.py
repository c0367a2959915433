"""Road-camera analytics as lazy PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from lanescope.slicer import Slicer

__all__ = ["Slicer"]

# The few Python functions sent to executors travel with the job; no copy has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
