"""Operators for preparing training text: one module per operator, each a function of DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
