"""Operators for training corpora."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the job, which need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
