"""Orrery: point-in-time relationship analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
