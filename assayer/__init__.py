"""Entity reconciliation and evidence graphs on Spark, and operators for training corpora."""

import sys

from pyspark import cloudpickle

# executors get this package's functions with the tasks, so it needn't be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
