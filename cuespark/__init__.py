"""cuespark: timed-text and speech-corpus operators for PySpark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so the package does not
# have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
