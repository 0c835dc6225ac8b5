"""Lodestone: hybrid document retrieval and corpus preparation on PySpark.

Python functions that Spark runs on executors are pickled by value, so a cluster
needs no copy of this package on its workers, only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
