"""estrado: a PySpark-native engine over large collections of sectioned court rulings."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

#: Kernels travel to the executors with their code, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
