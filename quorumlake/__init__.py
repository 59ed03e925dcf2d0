"""Spark-first engine for multi-annotator labelling data."""

import sys

from pyspark import cloudpickle

# Workers of a cluster need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
