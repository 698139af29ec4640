"""Shock-exposure analytics on Spark: bitemporal value-chain graphs, coverage series, event studies, documents."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
