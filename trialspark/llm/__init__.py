"""Training-data operators: dedup, language ID, sharding, decontamination, extraction, mixing, search, chat.

Nothing else in the library imports this subpackage; ``queries`` registers one query per operator.

Functions that run on executors travel with their job by value, so executors
need the public packages but no copy of this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
