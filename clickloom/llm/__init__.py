"""Operators for training-data pipelines: text, archives, duplicates, quality, packing.

Nothing outside this package imports it.  Functions that run inside tasks are
pickled by value, so executors need numpy and Spark but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
