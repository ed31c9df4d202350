"""Network-flow analytics written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
