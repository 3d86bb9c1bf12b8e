"""docquarry: document-retrieval analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with them, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
