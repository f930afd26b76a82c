"""tallyspan: Spark-native analytics of count observations against interval annotations.

Functions of this package are shipped to executors by value, so a driver that has the package on its
path is enough; the executors need only Python, numpy, pandas and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
