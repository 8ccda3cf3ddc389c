"""Operators for preparing training data: sharding, deduplication, mixing, search, scans, tokens.

What tasks run in Python travels with the job by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
