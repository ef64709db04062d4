"""Statuta: a PySpark-native engine for retrieval over legal and regulatory text.

``functions`` holds column expressions, ``operators`` the steps from text to answers,
``sources`` readers and writers, ``streaming`` incremental ingest, ``plans`` the
registered queries.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
