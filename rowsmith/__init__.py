"""Automated modelling on tables, written as Spark jobs.

Profile a table, decide between regression and classification, encode and impute,
fit a fixed list of models, rank them, keep them in a registry, and score new rows
in batch or as a stream.
"""

import sys

from pyspark import cloudpickle

# The functions sent to executors carry their own code, so the executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
