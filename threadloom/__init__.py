"""Conversation memory on Spark.

The few Python functions that run in tasks are shipped with the job, so executors need no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
