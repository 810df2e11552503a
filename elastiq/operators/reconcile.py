"""Compare published vendor lists with the table they were made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLISHED_ID = "vendor_ids"


def _places(with_cluster: bool) -> list[str]:
    return ["country_code", "cluster"] if with_cluster else ["country_code"]


def stored_ids(run: DataFrame, *, countries: Sequence[str] | None = None, label: str = "is_lb_lm") -> DataFrame:
    """The labelled vendors of one run of the history, in the countries that were published."""
    kept = run.filter(F.col(label) == "Y")
    if countries is not None:
        kept = kept.filter(F.col("country_code").isin(*countries))
    return kept.select("region", "country_code", "vendor_code")


def reconcile(
    published: DataFrame, table: DataFrame, *, table_id: str = "vendor_code", with_cluster: bool = False
) -> DataFrame:
    """Published and stored ids side by side with a status: both, published_only or table_only.

    Rows with status ``both`` are the matches. Equal rows are counted before the join and repeated after
    it, so an id listed very often, or many rows without an id, reach the join as one row.
    """
    places = _places(with_cluster)
    left = published.groupBy(*published.columns).agg(F.count(F.lit(1)).alias("_published"))
    right = table.groupBy(*places, table_id).agg(F.count(F.lit(1)).alias("_stored"))
    joined = left.withColumn("_key", F.col(PUBLISHED_ID)).join(
        right.withColumn("_key", F.col(table_id)), [*places, "_key"], "full_outer"
    )
    status = (
        F.when(F.col("_stored").isNull(), "published_only")
        .when(F.col("_published").isNull(), "table_only")
        .otherwise("both")
    )
    one = F.lit(1).cast("bigint")
    copies = F.sequence(one, F.coalesce("_published", one) * F.coalesce("_stored", one))
    rest = [c for c in published.columns if c not in (*places, PUBLISHED_ID)]
    return joined.select(
        *places, PUBLISHED_ID, table_id, *rest, status.alias("status"), F.explode(copies).alias("_copy")
    ).drop("_copy")


def reconcile_counts(
    published: DataFrame,
    table: DataFrame,
    compared: DataFrame,
    *,
    table_id: str = "vendor_code",
    with_cluster: bool = False,
    regions: Sequence[str] | None = None,
) -> DataFrame:
    """Ids published, stored and matched per country (and cluster). ``regions`` limits the stored side."""
    places = _places(with_cluster)
    if regions is not None:
        table = table.filter(F.col("region").isin(*regions))
    sides = {
        "published": (published, F.col(PUBLISHED_ID)),
        "in_table": (table, F.col(table_id)),
        "matched": (compared.filter(F.col("status") == "both"), F.col(table_id)),
    }
    tall = None
    for name, (df, value) in sides.items():
        marks = [value.isNotNull().cast("bigint") if n == name else F.lit(0).cast("bigint") for n in sides]
        part = df.select(*places, *[m.alias(n) for n, m in zip(sides, marks)])
        tall = part if tall is None else tall.unionByName(part)
    return tall.groupBy(*places).agg(*[F.sum(n).alias(n) for n in sides])


def reconcile_nulls(compared: DataFrame, *, table_id: str = "vendor_code") -> DataFrame:
    """How many compared rows lack the id of either side."""
    sides = F.array(
        *[F.struct(F.lit(c).alias("side"), F.col(c).isNull().alias("is_missing")) for c in (table_id, PUBLISHED_ID)]
    )
    return (
        compared.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.side").alias("side"), F.col("s.is_missing").alias("is_missing"))
        .agg(F.count(F.lit(1)).alias("num_rows"))
    )
