"""ledgerloom: a PySpark-native financial-warehouse analytics engine.

Everything is expressed as ``DataFrame -> DataFrame`` functions.  Functions that
do run on Python workers are shipped by value, so executors need no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
