"""Document audit and evidence statistics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the few Arrow-batched helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
