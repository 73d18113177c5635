"""Operators for building training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python functions of these modules travel to the executors with their code, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
