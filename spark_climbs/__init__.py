"""Road and trail climbs on Spark: find, measure, categorise and rank them."""

import sys

from pyspark import cloudpickle

# Ship the few pandas functions with their tasks, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
