"""A PySpark-native engine for versioned, append-only keyed data."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
