"""Log-anomaly analytics on Spark: parse, observe, smooth, detect, route, expire.

Functions that run inside Python tasks are pickled by value, so that executors need only the libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
