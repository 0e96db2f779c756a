"""Spark operators for preparing, scoring, scheduling and evaluating labelled text."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
