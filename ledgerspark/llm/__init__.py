"""Operators of a training-data pipeline: deduplication, language and toxicity
scoring, decontamination, URL filters, nearest neighbours and source mixing.

Every operator takes DataFrames and returns DataFrames; nothing else in the
package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the Python workers by value: executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
