"""Event notices, road impacts, incident history and cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions import text
from tripflow.functions.numeric import any_of

FEED_TIME = "dd/MM/yyyy HH:mm:ss"
HISTORY_TIME = "M/d/yyyy hh:mm:ss a"

EVENT_COLUMNS = (
    "ID", "EventName", "EventType", "EventSubType", "StartDate", "EndDate", "Latitude", "Longitude",
    "RoadwayName", "CountyName", "AsistanceLevel",
)


def _parse(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(value, F.lit(pattern)).cast("timestamp_ntz")


def with_dates(notices: DataFrame) -> DataFrame:
    """Start and end of the first schedule entry; null without one."""
    first = F.get("Schedule", F.lit(0))
    return notices.withColumns(
        {"StartDate": _parse(first["Start"], FEED_TIME), "EndDate": _parse(first["End"], FEED_TIME)}
    )


def with_history_times(history: DataFrame) -> DataFrame:
    return history.withColumns(
        {
            "create_time": _parse(F.col("Create Time"), HISTORY_TIME),
            "close_time": _parse(F.col("Close Time"), HISTORY_TIME),
        }
    )


def with_names(notices: DataFrame) -> DataFrame:
    """Event name and venue found in the whole description."""
    return (
        notices.withColumn("_text", text.notice_text(F.col("Description")))
        .withColumns({"EventName": text.event_name(F.col("_text")), "venue": text.venue_in(F.col("_text"))})
        .drop("_text")
    )


def prepare_notices(notices: DataFrame) -> DataFrame:
    """Cultural notices with dates, event name, venue, group and venue level.

    Operational and "Special event" subtypes are left out. The description and the
    schedule have served their purpose and are dropped; store the result before
    using it several times, since reading names out of long texts is the costly part.
    """
    subtype = F.col("EventSubType")
    cultural = notices.where((subtype != "Operational activity") & ~subtype.contains("Special event"))
    return (
        with_names(with_dates(cultural))
        .withColumns(
            {
                "AsistanceLevel": text.venue_level(F.col("RoadwayName")),
                "EventType": text.event_group(subtype),
            }
        )
        .select(*EVENT_COLUMNS, "venue")
    )


def split_impacts(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows at a listed venue are events, all others are road impacts."""
    at_venue = text.is_venue(F.col("RoadwayName"))
    return prepared.where(at_venue), prepared.where(~at_venue)


def _streets() -> Column:
    """Distinct streets as an array, each with the position first reported."""
    return F.struct(
        F.col("RoadwayName").alias("Street"),
        F.col("_first.Latitude").alias("Latitude"),
        F.col("_first.Longitude").alias("Longitude"),
    )


def _first_position() -> Column:
    """Position of the row with the smallest id, ids compared as numbers first."""
    rank = F.struct(F.col("ID").cast("bigint"), F.col("ID"))
    return F.min_by(F.struct("Latitude", "Longitude"), rank).alias("_first")


def match_impacts(events: DataFrame, impacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the streets of their impacts, and the impacts that match none.

    An impact belongs to an event when its text names the venue, both start at the
    same time and exactly one event does so. Events are counted per venue and start
    before the join, so an impact meets at most one row.
    """
    dated = events.where(F.col("StartDate").isNotNull())
    single = (
        dated.groupBy(F.lower("RoadwayName").alias("_venue"), F.col("StartDate").alias("_start"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("ID").alias("event_id"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
    on = (F.col("venue") == F.col("_venue")) & (F.col("StartDate") == F.col("_start"))
    # Impacts without venue or start match nothing; they pass by the join, where their null keys would meet in one task.
    keyed = F.col("venue").isNotNull() & F.col("StartDate").isNotNull()
    met = impacts.where(keyed).join(single, on, "left").drop("_venue", "_start")
    matched = met.where(F.col("event_id").isNotNull())
    unmatched = met.where(F.col("event_id").isNull()).drop("event_id").unionByName(impacts.where(~keyed))
    roads = (
        matched.groupBy("event_id", "RoadwayName")
        .agg(_first_position())
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_list(_streets())).alias("RoadsAffected"))
    )
    with_roads = (
        events.select(*EVENT_COLUMNS)
        .join(roads.withColumnRenamed("event_id", "ID"), "ID", "left")
        .withColumn("CountRoadsAffected", F.coalesce(F.size("RoadsAffected"), F.lit(0)))
    )
    return with_roads, unmatched


GROUP_KEYS = ("EventType", "EventSubType", "StartDate", "EventName")


def group_impacts(unmatched: DataFrame) -> DataFrame:
    """One row per event type, subtype, start and name of the impacts without an event.

    Several streets become "SEVERAL STREETS" at their mean position with the list of
    streets. Impacts lacking one of the keys form no group. Streets are made distinct
    before they are gathered.
    """
    keyed = unmatched.where(any_of([F.col(c).isNull() for c in GROUP_KEYS]) == F.lit(False))
    rank = F.struct(F.col("ID").cast("bigint"), F.col("ID"))
    per_street = keyed.groupBy(*GROUP_KEYS, "RoadwayName").agg(
        _first_position(),
        F.count(F.lit(1)).alias("_n"),
        F.sum("Latitude").alias("_lat"),
        F.sum("Longitude").alias("_lon"),
        F.min_by(F.struct(*[c for c in EVENT_COLUMNS if c not in GROUP_KEYS]), rank).alias("_top"),
        F.min(rank).alias("_rank"),
    )
    grouped = per_street.groupBy(*GROUP_KEYS).agg(
        F.min_by("_top", "_rank").alias("_top"),
        F.sort_array(F.collect_list(_streets())).alias("_roads"),
        (F.sum("_lat") / F.sum("_n")).alias("_lat"),
        (F.sum("_lon") / F.sum("_n")).alias("_lon"),
    )
    several = F.size("_roads") > 1

    def column(name: str) -> Column:
        if name in GROUP_KEYS:
            return F.col(name)
        top = F.col(f"_top.{name}")
        merged = {
            "RoadwayName": F.lit("SEVERAL STREETS"),
            "Latitude": F.col("_lat"),
            "Longitude": F.col("_lon"),
        }
        return (F.when(several, merged[name]).otherwise(top) if name in merged else top).alias(name)

    return grouped.select(
        *[column(c) for c in EVENT_COLUMNS],
        F.when(several, F.col("_roads")).alias("RoadsAffected"),
        F.when(several, F.size("_roads")).otherwise(0).alias("CountRoadsAffected"),
    )


def event_table(prepared: DataFrame) -> DataFrame:
    """Events with affected streets, and the grouped impacts no event explains."""
    events, impacts = split_impacts(prepared)
    with_roads, unmatched = match_impacts(events, impacts)
    return with_roads.unionByName(group_impacts(unmatched))


def events_on_day(events: DataFrame, day: Column) -> DataFrame:
    """Events whose interval of days holds the day."""
    return events.where((F.to_date("StartDate") <= day) & (F.to_date("EndDate") >= day))


def top_event_zones(located: DataFrame, n: int = 3, names: int = 3) -> DataFrame:
    """Zones by summed venue level, then by number of named events.

    Lists the names of the highest events of a zone. Ranking is within the zones
    that made the list only; because just the first ranks are kept, every map task
    sends at most that many rows per zone to the window.
    """
    keys = ["zone", "CountyName"]
    totals = (
        located.groupBy(*keys)
        .agg(
            F.count("EventName").alias("num_events"),
            F.coalesce(F.sum("AsistanceLevel"), F.lit(0)).alias("sum_assistance"),
        )
        .orderBy(F.desc("sum_assistance"), F.desc("num_events"), *keys)
        .limit(n)
    )
    best_first = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("AsistanceLevel"), "EventName", "ID")
    best = (
        located.where(F.col("EventName").isNotNull())
        .join(F.broadcast(totals.select(*keys)), keys, "left_semi")
        .withColumn("_rank", F.row_number().over(best_first))
        .where(F.col("_rank") <= names)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "EventName"))).alias("_names"))
    )
    return totals.join(best, keys, "left").select(
        *keys,
        "num_events",
        "sum_assistance",
        F.coalesce(F.col("_names.EventName"), F.array().cast("array<string>")).alias("list_names"),
    )


# ---- history ----------------------------------------------------------------

def event_counts(history: DataFrame, by: str) -> DataFrame:
    return history.groupBy(F.col(f"`{by}`").alias("value")).agg(F.count(F.lit(1)).alias("events"))


def with_category(history: DataFrame) -> DataFrame:
    """Normalised event type and its keyword category."""
    return history.withColumn("event_norm", text.normalize(F.col("Event Type"))).withColumn(
        "category", text.keyword_category(F.col("event_norm"))
    )


def category_buckets(history: DataFrame) -> DataFrame:
    """Sorted distinct event types of each category."""
    pairs = with_category(history).where(F.col("event_norm").isNotNull()).select("category", "event_norm").distinct()
    return pairs.groupBy("category").agg(F.sort_array(F.collect_list("event_norm")).alias("buckets"))


def modal_label(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Most frequent label per cluster, of several the first in the alphabet."""
    counts = df.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(cluster).agg(
        F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label))).alias("modal_label"),
        F.max("_n").alias("frequency"),
    )


def durations(history: DataFrame) -> DataFrame:
    """Minutes from creation to closing, positive ones only, with the category."""
    timed = with_category(with_history_times(history))
    minutes = F.timestamp_diff("MICROSECOND", F.col("create_time"), F.col("close_time")) / 60_000_000
    return timed.select("category", minutes.alias("minutes")).where(F.col("minutes") > 0)


def _histogram(df: DataFrame, value: str, low: Column, high: Column, bins: int, key: str) -> DataFrame:
    """Share per equal-width bin and key; the last bin holds its upper edge."""
    width = (high - low) / bins
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = (
        df.withColumn("bin", number)
        .groupBy(key, "bin")
        .agg(F.count(F.lit(1)).alias("events"), F.first(low + width / 2).alias("_first_center"), F.first(width).alias("_width"))
    )
    share = F.col("events") / F.sum("events").over(Window.partitionBy(key))
    return counts.withColumns(
        {"probability": share, "bin_center": F.col("_first_center") + F.col("bin") * F.col("_width")}
    ).drop("_first_center", "_width")


def duration_histogram(durations: DataFrame, bins: int = 8, limit: float = 168.0) -> DataFrame:
    """Duration shares per category over common equal-width bins, for minutes under ``limit``.

    The bin range comes from a scalar subquery, so nothing is collected.
    """
    kept = durations.where((F.col("category") != "construction") & (F.col("minutes") < limit))
    span = kept.agg(F.struct(F.min("minutes").alias("low"), F.max("minutes").alias("high")).alias("s")).scalar()
    ranged = kept.withColumn("_span", span)
    return _histogram(ranged, "minutes", F.col("_span.low"), F.col("_span.high"), bins, "category")


def construction_histogram(durations: DataFrame, bins: int = 24, max_hours: float = 72.0) -> DataFrame:
    """Shares of construction durations in hours up to ``max_hours``."""
    hours = durations.where(F.col("category") == "construction").select(
        "category", (F.col("minutes") / 60).alias("hours")
    ).where(F.col("hours") <= max_hours)
    span = hours.agg(F.struct(F.min("hours").alias("low"), F.max("hours").alias("high")).alias("s")).scalar()
    ranged = hours.withColumn("_span", span)
    return _histogram(ranged, "hours", F.col("_span.low"), F.col("_span.high"), bins, "category")


# ---- cameras ----------------------------------------------------------------

def cameras_by_zone(located: DataFrame) -> DataFrame:
    """Number, ids and video addresses of the cameras of each zone.

    A list is null when no camera of the zone has an entry; otherwise a missing entry
    keeps its place as an empty text.
    """
    entry = F.struct(
        F.col("ID"),
        F.coalesce(text.url_tail(F.col("Url")), F.lit("")).alias("tail"),
        F.coalesce("VideoUrl", F.lit("")).alias("video"),
    )
    grouped = located.groupBy("id_zone", "zone", "borough").agg(
        F.count(F.lit(1)).alias("num_cameras"),
        F.sort_array(F.collect_list(entry)).alias("_c"),
        F.count("Url").alias("_urls"),
        F.count("VideoUrl").alias("_videos"),
    )
    return grouped.select(
        "id_zone",
        "zone",
        "borough",
        "num_cameras",
        F.when(F.col("_urls") > 0, F.col("_c.tail")).alias("cameras_ids"),
        F.when(F.col("_videos") > 0, F.col("_c.video")).alias("video_urls"),
    )


def camera_map(located: DataFrame) -> DataFrame:
    """Zone id -> array of camera records, the layout of the camera file."""
    record = F.struct(
        "ID", "RoadwayName", "DirectionOfTravel", text.url_tail(F.col("Url")).alias("id_url_cam"), "VideoUrl", "Latitude", "Longitude"
    )
    return located.groupBy("id_zone").agg(F.sort_array(F.collect_list(record)).alias("cameras"))


def flatten_cameras(cameras: DataFrame) -> DataFrame:
    """Camera rows of the map that have both a road and a video address."""
    return (
        cameras.select("id_zone", F.inline("cameras"))
        .where((F.length("RoadwayName") > 0) & (F.length("VideoUrl") > 0))
    )
