"""Points of interest: life cycle, groups, counts, densities and socio-economic index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions.numeric import any_of, round_half_up
from tripflow.functions.text import strip_blanks
from tripflow.sources.reference_data import zone_dimension

# ---- fixed values -----------------------------------------------------------
POI_GROUPS = {
    "transport": (
        "amenity_parking", "amenity_taxi", "amenity_fuel", "public_transport_station", "toll_yes",
    ),
    "food_drink": ("amenity_restaurant", "amenity_cafe", "amenity_fast_food"),
    "healthcare": ("amenity_hospital", "amenity_clinic", "amenity_dentist"),
    "entertainment": (
        "amenity_cinema", "amenity_theatre", "tourism_museum", "amenity_events_venue",
        "amenity_music_venue",
    ),
    "tourism": (
        "tourism_attraction", "tourism_theme_park", "tourism_zoo", "tourism_yes",
        "historic_building",
    ),
    "nightlife_alcohol": (
        "amenity_nightclub", "amenity_pub", "amenity_biergarten", "amenity_casino",
        "amenity_stripclub", "amenity_bar",
    ),
    "accommodation": ("tourism_hotel", "tourism_motel", "building_hotel"),
    "education": ("amenity_university", "amenity_college", "amenity_school", "amenity_library"),
    "sports_fitness": ("leisure_fitness_centre", "leisure_stadium"),
    "government": ("amenity_courthouse", "office_diplomatic"),
    "commercial": ("shop_mall", "building_office"),
}
OTHER_GROUP = "other"

LIFECYCLE_PREFIXES = ("disused:", "was:", "demolished:", "abandoned:", "removed:")
CONSTRUCTION_KEYS = ("construction:amenity", "construction:shop", "construction:tourism")
OPENING_KEYS = ("opening_date", "start_date")

THEATRE_KINDS = {
    "theatre_opera": (
        "Metropolitan Opera House", "New York City Center", "BAM Howard Gilman Opera House",
    ),
    "theatre_ballet": (
        "Alvin Ailey American Dance Theater", "Brooklyn Ballet", "Mark Morris Dance Center",
    ),
    "theatre_philarmonic": (
        "David Geffen Hall", "Stern Auditorium", "Weill Recital Hall", "Zankel Hall",
        "Merkin Concert Hall", "Pabst Concert Hall", "Sarah Vaughan Concert Hall",
    ),
    "theatre_broadway": (
        "Gershwin Theatre", "Lyceum Theatre", "Majestic Theatre", "New Amsterdam Theatre",
        "Richard Rodgers Theatre", "Winter Garden Theatre", "Imperial Theatre",
        "August Wilson Theatre", "Minskoff Theatre", "Belasco Theatre", "Hudson Theatre",
        "Radio City Music Hall", "Lunt-Fontanne Theatre", "Barrymore Theatre",
        "Bernard B. Jacobs Theatre", "Samuel J. Friedman Theatre",
    ),
}

HIGH_SES_WEIGHTS = {
    "amenity_theatre_ballet": 1,
    "amenity_theatre_broadway": 1,
    "amenity_theatre_opera": 1,
    "amenity_theatre_philarmonic": 1,
    "tourism_gallery": 1,
}
LOW_SES_WEIGHTS = {
    "amenity_community_centre": -1,
    "amenity_social_facility": -1,
    "shop_money_lender": -3,
    "shop_pawnbroker": -3,
    "shop_second_hand": 0,
    "shop_variety_store": 0,
}
# ---- end of fixed values ----------------------------------------------------


def _lookup(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def poi_group(poi_type: Column) -> Column:
    members = {t: group for group, types in POI_GROUPS.items() for t in types}
    return F.coalesce(_lookup(poi_type, members), F.lit(OTHER_GROUP))


def theatre_kind(name: Column) -> Column:
    """Kind of a listed theatre, null for any other name."""
    kinds = {theatre: kind for kind, names in THEATRE_KINDS.items() for theatre in names}
    return _lookup(strip_blanks(name), kinds)


def reclassify_theatres(pois: DataFrame) -> DataFrame:
    return pois.withColumn("category", theatre_kind(F.col("name"))).where(F.col("category").isNotNull())


def tag_values(pois: DataFrame, key: str) -> DataFrame:
    """Distinct values of one tag, null standing for places without it."""
    return pois.select(F.try_element_at("tags", F.lit(key)).alias("value")).distinct()


def _opening(raw: Column) -> Column:
    """Date of an opening tag; a year or a year and month mean their first day."""
    text = F.trim(raw)
    formats = ("yyyy-MM-dd", "yyyy-MM", "yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def closing_reason(tags: Column, target_date: str) -> Column:
    """Why a place counts as closed on the date, null when it is open.

    A life cycle prefix, ``disused`` or a construction key with a value, or an
    opening after the date. A tag text that is no date decides nothing.
    """

    def closes(key: Column, value: Column) -> Column:
        by_prefix = any_of([key.startswith(p) for p in LIFECYCLE_PREFIXES])
        disused = (key == "disused") & (value != "")
        return value.isNotNull() & (by_prefix | disused | key.isin(*CONSTRUCTION_KEYS))

    closing_keys = F.array_sort(F.map_keys(F.map_filter(tags, closes)))
    late = []
    for key in OPENING_KEYS:
        raw = F.try_element_at(tags, F.lit(key))
        late.append(
            F.when(
                _opening(raw) > F.lit(target_date).cast("date"),
                F.concat(F.lit(key + "="), raw),
            )
        )
    return F.coalesce(F.get(closing_keys, F.lit(0)), *late)


def open_pois(pois: DataFrame, target_date: str) -> DataFrame:
    return pois.where(closing_reason(F.col("tags"), target_date).isNull())


def closing_reasons(pois: DataFrame, target_date: str) -> DataFrame:
    """Number of dropped places per reason."""
    return (
        pois.select(closing_reason(F.col("tags"), target_date).alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("dropped"))
    )


def counts_by_zone(
    located: DataFrame, zones: DataFrame, kind: str, values: list[str], zone_columns: list[str]
) -> DataFrame:
    """One row per zone, one count column per value; zones without places show 0.

    ``values`` names the columns, which spares the extra pass a free pivot needs.
    Places outside all zones are not counted.
    """
    pivoted = (
        located.where(F.col("id").isNotNull()).groupBy("id").pivot(kind, values).count()
    )
    dim = zone_dimension(pivoted, "id", *[f"`{v}`" for v in values])
    base = zones.select("id", *zone_columns)
    return base.join(dim, "id", "left").na.fill(0, subset=values)


def density(counts: DataFrame, columns: list[str], area: str = "area_miles2") -> DataFrame:
    """Places per square mile, 2 decimals; a zone without area has density 0."""
    others = [c for c in counts.columns if c not in columns]
    size = F.when(F.col(area) != 0, F.col(area))
    return counts.select(
        *others,
        *[
            round_half_up(F.coalesce(F.col(c) / size, F.lit(0.0)), 2).alias(f"{c}_per_mi2")
            for c in columns
        ],
    )


def share_in_group(located: DataFrame, min_pct: float = 3.0, rest: str = "Others") -> DataFrame:
    """Composition of each group by type; types under ``min_pct`` fold into one row."""
    counts = located.groupBy(poi_group(F.col("poi_type")).alias("poi_group"), "poi_type").agg(
        F.count(F.lit(1)).alias("_n")
    )
    group = Window.partitionBy("poi_group")
    typed = counts.where(F.col("poi_group") != OTHER_GROUP).withColumn(
        "total", F.sum("_n").over(group)
    )
    pct = round_half_up(F.col("_n") / F.col("total") * 100, 1)
    folded = typed.withColumn("_pct", pct).withColumn(
        "label", F.when(F.col("_pct") >= min_pct, F.col("poi_type")).otherwise(rest)
    )
    return folded.groupBy("poi_group", "label", "total").agg(
        F.sum("_n").alias("pois"), round_half_up(F.sum("_pct"), 1).alias("pct")
    )


def by_borough(located: DataFrame, zones: DataFrame) -> DataFrame:
    """Places per borough and group, with the totals of borough, group and city.

    The cube runs over the counts, not over the places.
    """
    dim = zone_dimension(zones, "id", "borough")
    counts = (
        located.join(dim, "id")
        .groupBy("borough", poi_group(F.col("poi_type")).alias("poi_group"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        counts.cube("borough", "poi_group")
        .agg(F.sum("_n").alias("pois"), F.grouping_id().alias("_g"))
        .withColumn(
            "level",
            F.element_at(
                F.array(*[F.lit(x) for x in ("borough_group", "borough", "group", "city")]),
                F.col("_g").cast("int") + 1,
            ),
        )
        .drop("_g")
    )


def top_bottom(densities: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The ``n`` zones with most and with least of each column.

    The bottom list leaves out zones with 0 when at least ``n`` others exist.
    """
    long = densities.unpivot(["id", "zone"], columns, "poi", "density")
    per_poi = Window.partitionBy("poi")
    positive = F.count(F.when(F.col("density") > 0, 1)).over(per_poi)
    eligible = (F.col("_positive") < n) | (F.col("density") > 0)
    ranked = (
        long.withColumn("_positive", positive)
        .withColumn("_low", F.when(eligible, F.col("density")))
        .withColumns(
            {
                "_top": F.row_number().over(per_poi.orderBy(F.desc("density"), "id")),
                "_bottom": F.row_number().over(per_poi.orderBy(F.asc_nulls_last("_low"), "id")),
            }
        )
    )
    sides = F.array(
        F.struct(F.lit("top").alias("side"), F.col("_top").alias("rank")),
        F.struct(F.lit("bottom").alias("side"), F.when(F.col("_low").isNotNull(), F.col("_bottom")).alias("rank")),
    )
    return (
        ranked.select("poi", "id", "zone", "density", F.inline(sides))
        .where(F.col("rank") <= n)
    )


def ses_index(located: DataFrame, zones: DataFrame, corrected_sign: bool = False) -> DataFrame:
    """High- and low-SES scores, densities and index per zone.

    Low-SES weights are negative, so subtracting their density raises the index;
    ``corrected_sign`` adds it instead.
    """

    def score(weights: dict) -> Column:
        return F.coalesce(F.sum(_lookup(F.col("poi_type"), weights)), F.lit(0)).cast("bigint")

    scores = (
        located.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(score(HIGH_SES_WEIGHTS).alias("high_SES_count"), score(LOW_SES_WEIGHTS).alias("low_SES_count"))
    )
    dim = zone_dimension(scores, "id", "high_SES_count", "low_SES_count")
    area = F.when(F.col("area_miles2") != 0, F.col("area_miles2"))
    joined = zones.join(dim, "id", "left").na.fill(
        0, subset=["high_SES_count", "low_SES_count"]
    )
    low = F.col("low_SES_density")
    return joined.withColumns(
        {
            "high_SES_density": F.col("high_SES_count") / area,
            "low_SES_density": F.col("low_SES_count") / area,
        }
    ).withColumn("SES_index", F.col("high_SES_density") + (low if corrected_sign else -low))
