"""Operators for training-data preparation, with their queries.

Functions that run on executors are shipped by value, so that a cluster needs no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
