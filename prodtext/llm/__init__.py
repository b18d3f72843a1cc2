"""Training-data operators.  ``prodtext.llm.queries`` holds their registered queries."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions that run in tasks travel with the task: executors need no copy of this package
register_pickle_by_value(sys.modules[__name__])
