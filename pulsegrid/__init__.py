"""pulsegrid: set-oriented PySpark operators for physiological recordings."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no local install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
