"""Operators for preparing language-model training data, and their queries.

Their functions travel to the tasks by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
