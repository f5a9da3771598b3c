"""Training-data operators for large text corpora.

Nothing else in the library imports this subpackage.  Executors need no copy of it: functions that
run in Python workers travel by value with the task that uses them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
