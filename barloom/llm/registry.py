"""Queries of this subpackage and the SQL that must give the same rows."""
QUERIES = {}
ORACLES = {}

#: DuckDB: words of a text; white space is space and \\t \\n \\v \\f \\r
WORDS = r"[x FOR x IN string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+') IF x <> '']"


def query(name, sql=None):
    """Registers fn(spark, sf_dir) under a name, with its SQL if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
