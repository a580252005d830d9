"""strayrows: find, explain and summarise unusual rows of large tables on Spark.

Every public function takes and returns DataFrames; randomness comes from
explicit seeds so a run can be repeated.
"""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel to executors by value, so a job needs
# no separate installation of the package on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
