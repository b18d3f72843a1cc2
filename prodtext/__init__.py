"""prodtext: product-text analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregates and windows, so Catalyst can push
filters into the scan, prune columns and pick the join strategy.
"""

__all__ = ["session"]

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

# functions that run in tasks travel with the task: executors need no copy of this package
_by_value(_sys.modules[__name__])
