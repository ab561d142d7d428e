"""corpusloom: text-corpus curation and declarative rules on PySpark DataFrames.

Functions that run in Python workers are pickled by value, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
