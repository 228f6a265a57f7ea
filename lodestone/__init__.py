"""Evidence retrieval and training-data processing as DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
