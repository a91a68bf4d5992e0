"""Registry of named queries and the shared, staged intermediates some of them read."""

from pyspark.sql import DataFrame

QUERIES, ORACLES = {}, {}
_STAGED = {}


def register(name: str, sql: str = None):
    """Decorator: a function (spark, sf_dir) -> DataFrame becomes a named query, with its reference SQL if any."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            from blockfield.catalog.sql import with_ctes

            ORACLES[name] = with_ctes(sql)
        return fn

    return keep


def staged(fn):
    """Compute an intermediate once per application and input folder; the function must return staged data."""
    def run(spark, sf_dir):
        key = (fn.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _STAGED:
            _STAGED[key] = fn(spark, sf_dir)
        return _STAGED[key]

    return run


def forget() -> None:
    """Drop references to staged intermediates (benchmarks call this between queries)."""
    _STAGED.clear()


def longs(df: DataFrame, *names: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*[F.col(n) for n in df.columns if n not in names], *[F.col(n).cast("bigint").alias(n) for n in names])
