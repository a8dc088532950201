"""quern: a PySpark engine for building, auditing and evaluating labelled message corpora."""

import sys

from pyspark import cloudpickle

# Python workers of a cluster need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
