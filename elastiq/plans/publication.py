"""The publication check: published lists against the table they were made from.

    spark-submit elastiq/plans/publication.py --published <folder> --history <folder> \\
        --run-ts 2024-02-15T00:00:00+00:00 --countries ae,sg --output <folder>
    spark-submit elastiq/plans/publication.py --published <folder> --clusters <folder, or catalog:schema.table> \\
        --regions Americas --output <folder>
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from elastiq.functions.skew import split_hot_keys
from elastiq.operators.reconcile import reconcile, reconcile_counts, reconcile_nulls, stored_ids
from elastiq.sources.history import read_run
from elastiq.sources.published import published_ids, read_published
from elastiq.sources.sinks import sink
from elastiq.sources.staging import drop_staged, stage
from elastiq.sources.tables import as_declared


def check(
    published: DataFrame,
    table: DataFrame,
    *,
    table_id: str = "vendor_code",
    with_cluster: bool = False,
    regions: list[str] | None = None,
) -> dict[str, DataFrame]:
    """The compared ids, their counts per country (and cluster), and the missing ids of either side."""
    options = {"table_id": table_id, "with_cluster": with_cluster}
    compared = stage(reconcile(published, table, **options), "reconciled")
    return {
        "reconciled": compared,
        "counts": reconcile_counts(published, table, compared, regions=regions, **options),
        "missing": reconcile_nulls(compared, table_id=table_id),
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("--published", required=True)
    parser.add_argument("--output", required=True)
    side = parser.add_mutually_exclusive_group(required=True)
    side.add_argument("--history")
    side.add_argument("--clusters")
    parser.add_argument("--run-ts", type=dt.datetime.fromisoformat)
    parser.add_argument("--countries", type=lambda text: text.split(","))
    parser.add_argument("--label", default="is_lb_lm")
    parser.add_argument("--regions", type=lambda text: text.split(","))
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("elastiq-publication").getOrCreate()
    split_hot_keys(spark)
    files = read_published(spark, args.published)
    if args.clusters:
        published = published_ids(files, with_cluster=True)
        in_catalog = args.clusters.startswith("catalog:")
        stored = spark.table(args.clusters.removeprefix("catalog:")) if in_catalog else spark.read.parquet(args.clusters)
        table = as_declared(stored, "vendors_clustered")
        out = check(published, table, table_id="vendor_id", with_cluster=True, regions=args.regions)
    else:
        published = published_ids(files)
        run = read_run(spark, args.history, args.run_ts)
        table = stored_ids(run, countries=args.countries, label=args.label)
        out = check(published, table, regions=args.regions)
    target = sink(spark, args.output)
    for name, df in out.items():
        target.replace(df, name)
    drop_staged(spark)


if __name__ == "__main__":
    main()
