"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small table that share a partition, so that a round doesn't write many tiny files.
ROWS = 100_000

#: A key with over one in so many of a table's rows is joined by broadcast.
FREQUENT = 256


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as its number of rows asks for, if it has more; no shuffle."""
    return df.coalesce(1 + rows // ROWS)


def frequent(rows: DataFrame, key: str) -> list:
    """Keys that over one in FREQUENT of the rows have: fewer than FREQUENT, whatever the table's size."""
    return [r[0] for r in rows.groupBy(key).count().where(F.col("count") > rows.count() / FREQUENT).select(key).collect()]


def beside(rows: DataFrame, found: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """``rows`` joined to ``found``, which has one row per key.

    The few frequent keys (``hot``, if known) meet their rows by broadcast, so no task gets all rows of one.
    """
    hot = frequent(rows, key) if hot is None else hot
    if not hot:
        return rows.join(found, key)
    is_hot = F.col(key).isin(hot)
    rest = rows.where(~is_hot).join(found.where(~is_hot), key)
    return rest.union(rows.where(is_hot).join(F.broadcast(found.where(is_hot)), key).select(rest.columns))


def components(links: DataFrame) -> DataFrame:
    """``vertex`` and ``root``, the smallest vertex of its component, from links ``a``, ``b``.

    Each round takes the smallest label among a vertex and its neighbours, and then the label's own
    label, so a path of n links takes about log n rounds. The labels are checkpointed every round.
    Minima are combined before the shuffle, and frequent vertices and labels are joined by broadcast, so a
    vertex with very many links and a component with very many vertices cost no task more.
    """
    links = links.where("a <> b").select("a", "b").distinct().checkpoint()
    count = links.count()
    links = narrowed(links, count)
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = ends.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("low")).select(
        "vertex", F.least("vertex", "low").alias("root")
    )
    labels = narrowed(labels, count).checkpoint()
    hot = frequent(ends, "b")
    while True:
        of_b = labels.select(F.col("vertex").alias("b"), F.col("root").alias("near"))
        near = beside(ends, of_b, "b", hot).select(F.col("a").alias("vertex"), "near", F.lit(None).cast("long").alias("before"))
        own = labels.select("vertex", F.col("root").alias("near"), F.col("root").alias("before"))
        stepped = near.union(own).groupBy("vertex").agg(F.min("near").alias("root"), F.max("before").alias("before"))
        stepped = narrowed(stepped, count).checkpoint()
        above = labels.select(F.col("vertex").alias("root"), F.col("root").alias("above"))
        jumped = beside(stepped, above, "root").select("vertex", "before", F.least("root", "above").alias("root"))
        jumped = narrowed(jumped, count).checkpoint()
        changed = jumped.where("root <> before").limit(1).count()
        labels = jumped.select("vertex", "root")
        if not changed:
            return labels
