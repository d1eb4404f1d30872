"""Keepsake: bulk analytics over agent and chat memory, written as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to Python workers travel with their code, so executors need no
# copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])
