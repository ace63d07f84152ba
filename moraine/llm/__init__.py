"""Training-data operators at corpus scale.  Nothing else in the library imports this subpackage.

Kernels that run in Python workers are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
