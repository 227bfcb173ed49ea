"""Operations of a training-data pipeline, each by one named method.

``queries.QUERIES`` holds the registered queries, ``queries.ORACLES`` their SQL.
Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
