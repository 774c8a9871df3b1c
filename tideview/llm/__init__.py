"""Operators for large training corpora. Nothing outside this folder imports it but the entry file."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# tasks get this folder's functions with their code, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])
