"""Chart-ready aggregates over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.functions import hour_number, to_number
from headwise.operators.ranking import top_n

# Fixed sizes of the charts.
TOP_ROUTES = 15
TOP_STOPS = 20
LABELLED_STOPS = 10
MARKER_BASE, MARKER_SPAN = 80, 520

def _most() -> Column:
    return F.desc("events")


def _named(events: DataFrame) -> DataFrame:
    """Stops without a published name appear in no stop chart."""
    return events.where(F.col("stop_name") != "")


def top_routes(events: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    table = events.groupBy("route_label").agg(
        F.count("*").alias("events"), F.count_distinct("stop_id").alias("stops")
    )
    return top_n(table, n, _most(), "route_label")


def top_route_directions(events: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    label = F.concat("route_label", F.lit(" dir "), "direction_id").alias("route_direction")
    return top_n(events.groupBy(label).agg(F.count("*").alias("events")), n, _most(), "route_direction")


def top_stops(events: DataFrame, n: int = TOP_STOPS) -> DataFrame:
    key = ["stop_id", "stop_name"]
    table = _named(events).groupBy(*key).agg(
        F.count("*").alias("events"), F.count_distinct("route_label").alias("routes")
    )
    label = F.concat("stop_name", F.lit(" ["), "stop_id", F.lit("]"))
    return top_n(table, n, _most(), *key).withColumn("stop_label", label)


def events_by_hour(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(hour_number(F.col("event_hour")).alias("hour_num"))
        .agg(F.count("*").alias("events"), F.count_distinct("route_label").alias("routes"))
        .orderBy("hour_num")
    )


def route_hour_matrix(events: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    """Events of the worst routes by hour of day: one row per route, 24 columns."""
    totals = events.groupBy("route_label").agg(F.count("*").alias("events"))
    worst = top_n(totals, n, _most(), "route_label")
    hours = [
        F.count_if(F.col("hour_num") == hour).alias(f"h{hour:02d}") for hour in range(24)
    ]
    return (
        events.select("route_label", hour_number(F.col("event_hour")).alias("hour_num"))
        .groupBy("route_label")
        .agg(*hours)
        .join(worst, "route_label")
        .orderBy(_most(), "route_label")
    )


def stop_locations(events: DataFrame, n: int = TOP_STOPS) -> DataFrame:
    """Positions of the worst stops with marker size; the first few are labelled."""
    key = ["stop_id", "stop_name", "stop_lat_num", "stop_lon_num"]
    located = _named(events).withColumns(
        {"stop_lat_num": to_number(F.col("stop_lat")), "stop_lon_num": to_number(F.col("stop_lon"))}
    ).dropna(subset=["stop_lat_num", "stop_lon_num"])
    worst = top_n(
        located.groupBy(*key).agg(
            F.count("*").alias("events"), F.count_distinct("route_label").alias("routes")
        ),
        n,
        _most(),
        *key,
    )
    # These windows see the n rows of the chart, nothing else.
    chart = Window.partitionBy()
    share = F.col("events") / F.max("events").over(chart)
    position = F.row_number().over(chart.orderBy(_most(), *key))
    return worst.select(
        "*",
        (F.lit(float(MARKER_BASE)) + share * F.lit(float(MARKER_SPAN))).alias("marker_size"),
        (position <= LABELLED_STOPS).alias("labelled"),
    )


def route_summary(events: DataFrame) -> DataFrame:
    """Totals, busiest named stop and busiest hour of every route."""

    def busiest(rows: DataFrame, key: list[str]) -> DataFrame:
        counts = rows.groupBy("route_label", *key).agg(F.count("*").alias("n"))
        return counts.groupBy("route_label").agg(
            F.min(F.struct((-F.col("n")).alias("minus"), *key, "n")).alias("top")
        )

    totals = events.groupBy("route_label").agg(
        F.count("*").alias("events"), F.count_distinct("stop_id").alias("stops")
    )
    stop = busiest(_named(events), ["stop_id", "stop_name"]).select(
        "route_label",
        F.col("top.stop_id").alias("top_stop_id"),
        F.col("top.stop_name").alias("top_stop_name"),
        F.col("top.n").alias("top_stop_events"),
    )
    hour = busiest(events, ["event_hour"]).select(
        "route_label", F.col("top.event_hour").alias("top_hour"), F.col("top.n").alias("top_hour_events")
    )
    return (
        totals.join(stop, "route_label", "left")
        .join(hour, "route_label", "left")
        .orderBy(_most(), "route_label")
    )


def chart_tables(
    events: DataFrame, routes: int = TOP_ROUTES, stops: int = TOP_STOPS
) -> dict[str, DataFrame]:
    """Every chart table by name. Give an event table that has been written."""
    return {
        "top_routes": top_routes(events, routes),
        "top_route_directions": top_route_directions(events, routes),
        "top_stops": top_stops(events, stops),
        "events_by_hour": events_by_hour(events),
        "route_hour_matrix": route_hour_matrix(events, routes),
        "stop_locations": stop_locations(events, stops),
        "route_summary": route_summary(events),
    }
