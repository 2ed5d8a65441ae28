"""Document analytics on Spark: sources, operators, functions, plans and streaming over collections of structured documents."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
