"""Training-data operators: quality, near-duplicates, tokens, packing, secrets, licences and addresses.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
