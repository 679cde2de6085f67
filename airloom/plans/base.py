"""Registry of queries: name -> (Spark function, DuckDB SQL)."""

QUERIES, SQL = {}, {}
#: Added before a mean is rounded: sums of floats differ by order in their last bits, so a mean on a tie rounds up wherever it was computed.
TIE = 1e-9


def query(name, sql=None):
    """Registers ``f(spark, sf_dir)``; ``sql`` runs in DuckDB on the same tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
