"""Operators of a training-data pipeline.

Nothing else in the library imports this package. Code of this package that
runs inside tasks travels with the task, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
