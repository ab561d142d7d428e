"""Operators for large training corpora.

Nothing outside this package imports it.  Functions that run in Python workers
are pickled by value, so executors need numpy, pyarrow and the small libraries
named in each module, but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
