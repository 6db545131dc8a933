"""Operators for preparing language-model training data.

Functions that run in Python workers travel to them by value, so that workers need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
