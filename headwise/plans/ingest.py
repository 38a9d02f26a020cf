"""One batch ingest cycle over both feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwise.sources.feeds import flatten_trip_updates, flatten_vehicles
from headwise.sources.tables import STOP_UPDATES, VEHICLES, ensure_tables, insert_new

SUMMARY = "feed string, parsed_rows bigint, unique_rows bigint, new_rows bigint, error string"


def ingest(spark: SparkSession, feed: DataFrame, schema: str, batch_id: str) -> DataFrame:
    """Insert one landed batch into both tables; rows parsed, unique and new per feed.

    `feed` holds landed entities and is read once per feed. A feed that fails is reported with its
    error while the other is still taken in; an error is raised only when both fail.
    """
    ensure_tables(spark, schema)
    lines, causes = [], []
    for table, flatten in ((VEHICLES, flatten_vehicles), (STOP_UPDATES, flatten_trip_updates)):
        try:
            counts = insert_new(spark, schema, table, flatten(feed), batch_id)
            lines.append((table.name, counts["parsed"], counts["unique"], counts["new"], None))
        except Exception as cause:
            causes.append(cause)
            lines.append((table.name, None, None, None, str(cause).strip().splitlines()[0]))
    if len(causes) == len(lines):
        raise RuntimeError(f"batch {batch_id!r} of {schema}: neither feed could be taken in") from causes[0]
    return spark.createDataFrame(lines, SUMMARY)
