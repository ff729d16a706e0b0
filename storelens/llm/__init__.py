"""Operators of a training-data pipeline (search, dedup, scoring, tokens, archives).

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface; ``queries`` holds the registered queries.
"""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code: the library need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
