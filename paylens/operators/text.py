"""Text aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_text(
    df: DataFrame, group: str, counted: str, count_as: str, text: str, text_as: str,
    separator: str,
) -> DataFrame:
    """Per group: how many ``counted`` values, and its texts joined in order.

    Equal texts of a group are counted first, so what is gathered per group is
    its different texts, not its rows.
    """
    per_text = df.groupBy(group, text).agg(
        F.count(counted).alias("ids_"), F.count(F.lit(1)).alias("n_")
    )
    entry = F.when(F.col(text).isNotNull(), F.struct(F.col(text).alias("s"), F.col("n_")))
    grouped = per_text.groupBy(group).agg(
        F.sum("ids_").alias(count_as), F.sort_array(F.collect_list(entry)).alias("texts_")
    )
    repeated = F.transform(
        "texts_",
        lambda e: F.concat(
            F.repeat(F.concat(e.s, F.lit(separator)), (e.n_ - 1).cast("int")), e.s
        ),
    )
    whole = F.when(F.size("texts_") > 0, F.array_join(repeated, separator))
    return grouped.select(group, count_as, whole.alias(text_as))
