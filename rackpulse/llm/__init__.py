"""Training-data operators: token counts, language, licences, quality, toxicity, exact search, mixing,
near duplicates, web archives and benchmark decontamination.

One module per operator; ``registry`` holds the registered queries (``opN_<name>`` and ``pipeline``) and their DuckDB
SQL. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
