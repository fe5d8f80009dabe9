"""gneiss: a PySpark-native engine for tabular analytics and corpus preparation.

Every public operator takes and returns DataFrames.  The package travels with
the tasks by value, so executors need no copy of it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
