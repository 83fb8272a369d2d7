"""Operators for training-data corpora.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries.  Task code is pickled by value, so executors need numpy, pandas and
pyarrow but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
