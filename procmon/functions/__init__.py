"""Column-level helpers (expressions only, no actions)."""

from pyspark.sql import DataFrame


def bounded_collect(df: DataFrame, max_rows: int):
    """Rows of a small derived table, or ``None`` when it has more than ``max_rows`` rows.

    The table is persisted, counted (one pass over its inputs) and only then collected
    from the cache, so nothing larger than ``max_rows`` ever reaches the driver."""
    small = df.persist()
    try:
        if small.count() > max_rows:
            return None
        return small.collect()
    finally:
        small.unpersist()
