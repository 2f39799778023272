"""Bounded samples of labelled texts for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(items: DataFrame, labels: DataFrame, id: str, text: str, label: str, per_class: int, letters: int) -> list[tuple[bytes, int]]:
    """At most ``per_class`` labelled rows of each class, the first by a hash of the id, with texts of at most ``letters`` characters.

    Rows are drawn from the labels alone, so only the drawn texts leave their
    place; the list of drawn ids is bounded by ``per_class``. Null ids, labels and
    texts give no sample. The sample does not depend on the partitions.
    """
    known = labels.select(F.col(id).alias("_k"), F.col(label).alias("_y")).filter("_k IS NOT NULL AND _y IN (0, 1)").distinct()
    hashed = known.withColumn("_h", F.xxhash64("_k"))
    drawn = []
    for r in known.groupBy("_y").count().collect():
        # a hash below this share of its range is drawn; a quarter more than needed makes up for chance
        share = min(1.0, 1.25 * per_class / r["count"])
        rows = hashed.filter((F.col("_y") == r._y) & (F.shiftrightunsigned("_h", 11) < F.lit(int(share * 2**53)))).collect()
        drawn += sorted(((x._h, x._k, x._y) for x in rows))[:per_class]
    if not drawn:
        return []
    schema = f"_h bigint, _k {known.schema['_k'].dataType.simpleString()}, _y int"
    picked = F.broadcast(items.sparkSession.createDataFrame(drawn, schema))  # at most per_class rows of each class
    texts = items.select(F.col(id).alias("_k"), F.col(text).cast("string").alias("_text")).filter(
        F.col("_text").isNotNull() & (F.char_length("_text") <= letters)
    )
    found = sorted((r._h, r._k, r._y, r._text) for r in texts.join(picked, "_k").select("_h", "_k", "_y", "_text").collect())
    counts, out = {0: 0, 1: 0}, []
    for _, _, y, t in found:  # an id may have several rows
        counts[y] += 1
        if counts[y] <= per_class:
            out.append((t.encode(), y))
    return out
