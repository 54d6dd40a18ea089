"""Named queries and, next to each, the plain SQL that must give the same rows."""
from functools import wraps

from barloom.plans.ctes import with_ctes
from barloom.sources.bindings import Tables

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a query; shared SQL tables its text reads are put in front of it."""
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return run
    return register
