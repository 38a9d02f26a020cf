"""Transit-shaped views over the given tables (formulas: FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwise.sources.static import Timetable

ZONE = "America/Los_Angeles"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stop(order: Column, part: Column) -> Column:
    """Seven stops per route out of forty."""
    return ((order % 25 * 3 + part % 7) % 40).cast("string")


def stop_time_updates(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Four snapshots of every line; the last only in a second capture, the second in both.

    With `dealt`, for `trip_update_feed`, lines are dealt by trip before they are multiplied.
    """
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    month = F.date_trunc("month", "l_shipdate")
    copied = order % 25 % 3 == 0
    place = lambda s, copy: F.struct(F.lit(s).alias("s"), F.lit(copy).alias("copy"))
    main = F.array(*[place(s, False) for s in range(3)])
    both = F.concat(main, F.array(place(1, True), place(3, True)))
    # The hour moves by seven from month to month; the 29th has the autumn clock change of two years.
    hour = ((F.year("month") * 12 + F.month("month")) * 7 + 10) % 24
    # What all snapshots of a line share is derived before it is multiplied.
    lines = _table(spark, sf_dir, "lineitem").withColumn("month", month).select(
        order.cast("string").alias("trip_id"),
        F.when(order % 97 != 0, (order % 25).cast("string")).alias("route_id"),
        F.when(order % 89 != 0, line.cast("bigint")).alias("stop_sequence"),
        F.when(order % 83 != 0, _stop(order, F.col("l_partkey"))).alias("stop_id"),
        (order % 79 != 0).alias("timed"),
        (line % 3).alias("late"),
        (F.col("l_quantity") * 60).cast("bigint").alias("ahead"),
        (F.unix_timestamp("month") + 28 * 86400 + hour * 3600 + 1800).alias("start"),
        F.year("month").cast("string").alias("year"),
        copied.alias("copied"),
    )
    if dealt:
        lines = lines.repartition("trip_id")
    places = F.when(F.col("copied"), both).otherwise(main)
    s = F.col("at.s")
    delay = (s * F.col("late") * 20).cast("bigint")
    arrival = F.col("start") + F.col("ahead") + delay
    stamp = F.col("start") + s * 20
    return lines.select("*", F.explode(places).alias("at")).select(
        "trip_id",
        "route_id",
        "stop_sequence",
        "stop_id",
        delay.alias("arrival_delay"),
        F.when(F.col("timed"), arrival).alias("arrival_time"),
        delay.alias("departure_delay"),
        (arrival + 30).alias("departure_time"),
        stamp.alias("feed_timestamp"),
        F.timestamp_seconds(stamp).alias("logged_at"),
        F.concat(F.when(F.col("at.copy"), "copy+of%").otherwise("capture_"), "year").alias("source_db"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order; multiples of 17 are published under a trip id nobody observes."""
    key = F.col("o_orderkey")
    trip_id = F.when(key % 17 == 0, F.concat(F.lit("unlisted-"), key)).otherwise(key.cast("string"))
    return _table(spark, sf_dir, "orders").select(
        (key % 25).cast("string").alias("route_id"),
        F.col("o_orderstatus").alias("service_id"),
        trip_id.alias("trip_id"),
        F.col("o_orderpriority").alias("trip_headsign"),
        (F.floor(key / 5) % 2).cast("string").alias("direction_id"),
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        _table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("part"))
    )
    minute = F.col("l_orderkey") * 7 % 1440 + F.col("l_linenumber") * 5
    clock = F.format_string("%d:%02d:00", F.floor(minute / 60), minute % 60)
    return lines.select(
        F.col("l_orderkey").cast("string").alias("trip_id"),
        F.when(F.col("l_orderkey") % 29 == 0, "bad").otherwise(clock).alias("arrival_time"),
        _stop(F.col("l_orderkey"), F.col("part")).alias("stop_id"),
        F.col("l_linenumber").cast("string").alias("stop_sequence"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    return _table(spark, sf_dir, "nation").select(
        key.cast("string").alias("route_id"),
        F.when(key == 4, "").otherwise(name).alias("route_short_name"),
        F.concat(F.lit("Line "), name).alias("route_long_name"),
        F.when(key.isin(1, 4), "").otherwise(F.concat(F.lit("Nation "), name)).alias("route_desc"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts fall into forty stops; the lowest part of a stop names and places it."""
    places = (
        _table(spark, sf_dir, "part")
        .groupBy((F.col("p_partkey") % 40).alias("stop"))
        .agg(F.min("p_partkey").alias("part"), F.min_by("p_name", "p_partkey").alias("name"))
    )
    hundredths = F.col("part") / F.lit(100.0)
    return places.select(
        F.col("stop").cast("string").alias("stop_id"),
        F.when(F.col("stop") == 19, "")
        .when(F.col("stop") % 5 == 3, F.concat(F.lit("  "), F.col("name"), F.lit('\nbay "B", ')))
        .otherwise(F.col("name"))
        .alias("stop_name"),
        F.when(F.col("stop") == 18, "n/a")
        .otherwise(F.format_string("%.2f", F.lit(47.5) + hundredths))
        .alias("stop_lat"),
        F.format_string("%.2f", F.lit(-122.3) + hundredths).alias("stop_lon"),
    )


def timetable(spark: SparkSession, sf_dir: str) -> Timetable:
    return Timetable(
        zone=ZONE,
        routes=routes(spark, sf_dir),
        stops=stops(spark, sf_dir),
        trips=trips(spark, sf_dir),
        stop_times=stop_times(spark, sf_dir),
    )


def vehicle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with the event's number as `entity_index`."""
    number = F.col("event_id")
    vehicle_id = F.when(number % 50 != 0, F.concat(F.lit("V"), F.col("user_id").cast("string")))
    return _table(spark, sf_dir, "events").select(
        vehicle_id.alias("vehicle_id"),
        number.cast("string").alias("trip_id"),
        (number % 5).cast("string").alias("route_id"),
        (47 + F.col("value") / 1000).alias("latitude"),
        (-122 - F.col("value") / 1000).alias("longitude"),
        (number % 360).cast("double").alias("bearing"),
        F.col("value").alias("speed"),
        F.unix_timestamp(F.date_trunc("day", "ts")).alias("vehicle_timestamp"),
        F.col("ts").cast("timestamp").alias("logged_at"),
        number.alias("entity_index"),
    )


def vehicle_feed(positions: DataFrame) -> DataFrame:
    """Positions nested as feed entities; missing text is sent as an empty string."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("vehicle_id", "trip_id", "route_id")}
    vehicle = F.struct(
        F.struct(text["vehicle_id"].alias("id")).alias("vehicle"),
        F.struct(text["trip_id"].alias("trip_id"), text["route_id"].alias("route_id")).alias("trip"),
        F.struct("latitude", "longitude", "bearing", "speed").alias("position"),
        F.col("vehicle_timestamp").alias("timestamp"),
    )
    return positions.select("logged_at", "entity_index", vehicle.alias("vehicle"))


def trip_update_feed(updates: DataFrame) -> DataFrame:
    """Predictions nested as feed entities: one trip of one snapshot each.

    `updates` comes from `stop_time_updates`: a trip has a handful of predictions per
    snapshot. They are put in a total order, so that ordinals mean the same every time.
    """
    prediction = F.struct(
        "stop_sequence",
        "stop_id",
        F.struct(F.col("arrival_delay").alias("delay"), F.col("arrival_time").alias("time")).alias("arrival"),
        F.struct(F.col("departure_delay").alias("delay"), F.col("departure_time").alias("time")).alias("departure"),
    )
    trip = ["trip_id", "route_id", "feed_timestamp", "logged_at"]
    # One sort of small groups, of which a hash aggregate of lists would make two.
    entity = Window.partitionBy(*trip)
    listed = updates.select(
        *trip,
        F.collect_list(prediction).over(entity).alias("predictions"),
        F.row_number().over(entity.orderBy("logged_at")).alias("nth"),
    )
    return listed.where("nth = 1").select(
        "logged_at",
        F.col("trip_id").cast("bigint").alias("entity_index"),
        F.struct(
            F.struct("trip_id", "route_id").alias("trip"),
            F.col("feed_timestamp").alias("timestamp"),
            F.array_sort("predictions").alias("stop_time_update"),
        ).alias("trip_update"),
    )
