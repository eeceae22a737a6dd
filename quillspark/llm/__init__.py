"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage. Its functions are pickled by value, so
executors need the third-party packages but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
