"""Usage and quota analytics for AI coding assistants, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions run on executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
