import sys

from pyspark import cloudpickle

from catalogue import checking, running, shaping

QUERIES = {**shaping.QUERIES, **checking.QUERIES, **running.QUERIES}
SQL = {**shaping.SQL, **checking.SQL, **running.SQL}

# Row functions of the queries travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
