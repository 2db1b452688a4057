"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; ``__spark_entry__.py`` adds its queries when it is present."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
