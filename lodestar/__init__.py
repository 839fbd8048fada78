"""Lodestar: DataFrame operators for geographic question/answer corpora and training text."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
