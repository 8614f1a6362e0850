"""Operators for preparing training text, and their queries. Nothing else imports this folder.

The functions which run inside Python workers travel with their tasks, so that executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
