"""Spark-native surrogate modelling for tabular experiment data.

Everything works on DataFrames: statistics are aggregates, fitted statistics
become literal column expressions, and linear-algebra fits reduce small blocks
computed inside the tasks.  Only parameters (never rows) reach the driver.
"""

import sys

from pyspark import cloudpickle

# Functions of this package run inside Python workers.  Shipping them by value
# means a cluster needs no copy of the package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from emulon.roles import PipelineSpec, Roles  # noqa: E402
from emulon.models import fit, load_model  # noqa: E402
from emulon.plans.scoring import Scorer, score, score_row  # noqa: E402
from emulon.plans.training import prepare, train_and_evaluate  # noqa: E402

__all__ = [
    "PipelineSpec",
    "Roles",
    "Scorer",
    "fit",
    "load_model",
    "prepare",
    "score",
    "score_row",
    "train_and_evaluate",
]
