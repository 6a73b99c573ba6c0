"""Artifacts as JSON of a bounded number of bytes.

Lists shrink in proportion first, then texts; where that is not enough, only what names the artifact is left.
All of it is column expressions on one row; lists should come from an answer that is limited already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most and fewest bytes that may be asked for, passes, bounds of a pass's ratio, margin.
MOST, LEAST, PASSES = 50 * 1024, 4 * 1024, 8
LIST_RATIOS, TEXT_RATIOS, MARGIN = (0.02, 0.75), (0.05, 0.75), 0.9


def within_bytes(df: DataFrame, names: list[str], lists: list[str], texts: tuple[str, ...] = (), ceiling: int = MOST) -> DataFrame:
    """names, artifact (JSON of names, lists and texts), n_bytes, truncated, and n_<list>, the items kept, for every row of df.

    Null lists and texts are empty. A list or text that is not empty keeps one item or character through the passes.
    """
    ceiling = max(LEAST, min(ceiling, MOST))
    parts = [*lists, *texts]
    df = df.select(*names, *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in lists], *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts])

    def body(kept: Column) -> Column:
        cut = [F.slice(F.col(c), F.lit(1), kept[c]).alias(c) for c in lists] + [F.substring(F.col(c), F.lit(1), kept[c]).alias(c) for c in texts]
        return F.to_json(F.struct(*names, *cut))

    def shrink(columns, ratios):
        def step(kept: Column, _: Column) -> Column:
            size = F.octet_length(body(kept))
            ratio = F.greatest(F.lit(ratios[0]), F.least(F.lit(ratios[1]), F.lit(float(ceiling)) / size * F.lit(MARGIN)))
            less = {c: F.least(kept[c], F.greatest(F.lit(1), F.floor(kept[c] * ratio).cast("int"))) if c in columns else kept[c] for c in parts}
            return F.when(size <= ceiling, kept).otherwise(F.struct(*[v.alias(c) for c, v in less.items()]))

        return step

    whole = F.struct(*[F.size(c).alias(c) for c in lists], *[F.length(c).alias(c) for c in texts])
    passes = F.sequence(F.lit(1), F.lit(PASSES))
    out = df.withColumn("_kept", F.aggregate(passes, whole, shrink(lists, LIST_RATIOS)))
    if texts:
        out = out.withColumn("_kept", F.aggregate(passes, F.col("_kept"), shrink(texts, TEXT_RATIOS)))
    out = out.withColumn("_body", body(F.col("_kept"))).withColumn("_fits", F.octet_length("_body") <= ceiling)
    out = out.withColumn("artifact", F.when(F.col("_fits"), F.col("_body")).otherwise(F.to_json(F.struct(*names))))
    counts = [F.when(F.col("_fits"), F.col("_kept")[c]).otherwise(0).alias(f"n_{c}") for c in lists]
    return out.select(*names, "artifact", F.octet_length("artifact").alias("n_bytes"), (~F.col("_fits") | (F.col("_kept") != whole)).alias("truncated"), *counts)
