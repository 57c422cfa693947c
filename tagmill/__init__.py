"""tagmill: find, label, mask and measure personal data in text payloads with Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Arrow functions travel with their code, so executors need no installed package.
register_pickle_by_value(sys.modules[__name__])
