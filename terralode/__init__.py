"""terralode: territorial and operational analytics as Spark jobs."""

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code with them, so that workers need no installed copy of this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
