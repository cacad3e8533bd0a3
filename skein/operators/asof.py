"""As-of joins of two tables: for each row the latest row of the other table at or before its instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Units of time (seconds, where times are) that a task orders at once for a key.
STRETCH = 86_400.0


def as_of(left: DataFrame, right: DataFrame, by: list[str], t: str = "t", right_t: str | None = None, ties: list[str] | None = None, within: float | None = None, stretch: float = STRETCH, name: str = "as_of") -> DataFrame:
    """``left`` and, as the struct ``name``, the last row of ``right`` with the same ``by`` whose instant is at or before that of the left row.

    Instants are numbers. Of right rows at one instant the last by ``ties`` counts. With ``within``, a row that is more than
    so long before does not. The struct is null where there is no such row, where a ``by`` is null on either side, or an
    instant is. All left rows stay, repeated ones too.

    Both tables are laid side by side and ordered within stretches of time of a key, and what holds at a stretch's
    begin comes from the stretches before it, one row each. So neither a key with very many rows nor a pair of tables
    that differ in size is ordered, or multiplied, in one task.
    """
    right_t = right_t or t
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    held = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    order = F.struct(F.col(f"`{right_t}`").cast("double").alias("t"), *[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(ties or [])])
    keys = [f"__b{k}" for k in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    rows = left.select(*named, F.col(f"`{t}`").cast("double").alias("__x"), row.alias("__row"))
    others = right.select(*named, F.col(f"`{right_t}`").cast("double").alias("__x"), F.struct(order.alias("o"), held.alias("v")).alias("__held")).dropna(subset=[*keys, "__x"])
    bucket = F.floor(F.col("__x") / stretch).alias("__bucket")
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = rows.select("*", bucket, nothing(others, "__held")).unionByName(others.select("*", bucket, nothing(rows, "__row")))
    # at one instant the right rows come first, so that a left row sees them
    place = Window.partitionBy(*keys, "__bucket").orderBy("__x", F.col("__row").isNotNull(), F.col("__held.o")).rowsBetween(Window.unboundedPreceding, 0)
    ends = others.select("*", bucket).groupBy(*keys, "__bucket").agg(F.max_by("__held", "__held.o").alias("__end"))
    asked = rows.select(*keys, bucket).distinct().join(ends, [*keys, "__bucket"], "full_outer")
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = asked.withColumn("__before", before).where("__before IS NOT NULL").select(*keys, "__bucket", "__before")
    seen = both.withColumn("__seen", F.last("__held", ignorenulls=True).over(place)).where("__row IS NOT NULL")
    met = seen.join(carried, [*keys, "__bucket"], "left").withColumn("__seen", F.coalesce("__seen", "__before"))
    near = F.lit(True) if within is None else F.col("__x") - F.col("__seen.o.t") <= within
    usable = F.col("__x").isNotNull() & near
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return met.select("__row.*", F.when(usable, F.col("__seen.v")).alias(name))
