"""Operators for building training corpora; nothing else in the library imports them.

Functions that run on executors travel by value, so workers need not have the
package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
