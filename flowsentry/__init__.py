"""Flowsentry: network-security analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame. Event time is the ``ts_us`` column
(microseconds since the epoch, BIGINT), so that window bounds are exact integers.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
