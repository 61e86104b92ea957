import sys

from pyspark import cloudpickle

# The functions that open files inside tasks travel with the task, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
