"""Operators for training-data pipelines, one module per operator.

Nothing outside this package imports it.  ``queries.py`` holds the registered
queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
