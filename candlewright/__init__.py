"""candlewright: ordered bar-series analytics on PySpark."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
