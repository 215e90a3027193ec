"""Offline monitoring of signal temporal logic requirements on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a cluster needs no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
