"""Histogram analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so that the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from fillwise.operators.histogram import Histogram, histogram, histo_1d, histo_2d, histo_3d, histo_nd, sum_and_count  # noqa: E402
from fillwise.operators.lookup import filter_intervals, histogram_value, lookup, tensor_payload  # noqa: E402
from fillwise.operators.quantiles import build_quantiles, build_quantiles_from_fine, define_quantiles  # noqa: E402
from fillwise.operators.runner import Dataset, build_and_run  # noqa: E402
from fillwise.operators.shift import shifted_histogram  # noqa: E402
from fillwise.plans import axes  # noqa: E402

__all__ = [
    "Dataset", "Histogram", "axes", "build_and_run", "build_quantiles", "build_quantiles_from_fine", "define_quantiles", "filter_intervals", "histo_1d", "histo_2d",
    "histo_3d", "histo_nd", "histogram", "histogram_value", "lookup", "shifted_histogram", "sum_and_count", "tensor_payload",
]
