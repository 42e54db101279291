"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# what tasks run travels by value, so that only the driver needs the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
