"""Proofline: auditing of language-model outputs as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

#: Executors need no copy of this package: functions sent to them carry their code.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
