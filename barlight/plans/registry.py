"""The queries by name: a function of (spark, sf_dir), and DuckDB SQL that gives the same rows."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put
