"""Registered levels, index, statistics, sampling, lookups and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.config import LEVEL_CUTS, LEVEL_LABELS, TIP_LABELS, TIP_VALUES
from tripflow.functions.numeric import round_half_up
from tripflow.operators import enrich, levels, lookups, panel, places, quality, rollups, scoring, stats
from tripflow.plans import inputs
from tripflow.plans.check_sql import demand_sql, query, r, tip_cat
from tripflow.plans.inputs import YELLOW_CITY
from tripflow.plans.quality_queries import SALES_CLEAN
from tripflow.plans.registry import register
from tripflow.plans.rollup_queries import rounded
from tripflow.plans.source_queries import scanned_sales

# ---- shares and levels ------------------------------------------------------

SHARES = {
    "shares": "SELECT time_of_day, pickup_zone, count(*) AS trip_number, CAST(sum(count(*)) OVER (PARTITION BY time_of_day) AS BIGINT) AS total_trips_per_time FROM fhvhv_trips GROUP BY 1, 2",
    "demanded": f"SELECT *, {r('trip_number / total_trips_per_time * 100', 4)} AS avg_demand FROM shares",
    "cuts": "SELECT "
    + ", ".join(
        f"min(trip_number) FILTER (WHERE n_upto >= ceil({c}::DOUBLE * n)) AS n{i}, min(avg_demand) FILTER (WHERE a_upto >= ceil({c}::DOUBLE * n)) AS a{i}"
        for i, c in enumerate(LEVEL_CUTS)
    )
    + " FROM (SELECT *, row_number() OVER (ORDER BY trip_number) AS n_upto, row_number() OVER (ORDER BY avg_demand) AS a_upto, count(*) OVER () AS n FROM demanded)",
}


def level_sql(column, prefix):
    return "CASE " + " ".join(f"WHEN {column} <= {prefix}{i} THEN '{label}'" for i, label in enumerate(LEVEL_LABELS[:-1])) + f" ELSE '{LEVEL_LABELS[-1]}' END"


@register("demand_share", query("SELECT * FROM demanded", SHARES))
def demand_share(spark, sf):
    return levels.demand_share(inputs.fhvhv_rides(spark, sf))


@register(
    "demand_levels",
    query(f"SELECT demanded.*, {level_sql('trip_number', 'n')} AS level, {level_sql('avg_demand', 'a')} AS avg_level FROM demanded, cuts", SHARES),
)
def demand_levels(spark, sf):
    return levels.demand_levels(inputs.fhvhv_rides(spark, sf))


SCALED = ["avg_tip_pct", "total_trips", "avg_daily_pickups", "median_fare"]


def norm_sql(c):
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) END"


@register(
    "minmax_scale",
    query("SELECT PULocationID, " + ", ".join(f"{r(norm_sql(c), 6)} AS {c}_norm" for c in SCALED) + " FROM zone_demand"),
)
def minmax_scale(spark, sf):
    scaled = levels.minmax_scale(rollups.zone_demand(inputs.all_trips(spark, sf)), SCALED)
    return scaled.select("PULocationID", *[round_half_up(F.col(f"{c}_norm"), 6).alias(f"{c}_norm") for c in SCALED])


# ---- wealth -----------------------------------------------------------------

def weight_sql(weights):
    return "CASE poi_type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in weights.items()) + " END"


WEALTH = {
    "ses": f"""SELECT z.*, coalesce(high, 0) AS "high_SES_count", coalesce(low, 0) AS "low_SES_count",
        coalesce(high, 0) / nullif(area_miles2, 0) AS "high_SES_density", coalesce(low, 0) / nullif(area_miles2, 0) AS "low_SES_density"
        FROM zone_areas z LEFT JOIN (SELECT id, CAST(coalesce(sum({weight_sql(places.HIGH_SES_WEIGHTS)}), 0) AS BIGINT) AS high,
        CAST(coalesce(sum({weight_sql(places.LOW_SES_WEIGHTS)}), 0) AS BIGINT) AS low FROM ses_pois GROUP BY 1) s ON s.id = z.id""",
    "flagged": """SELECT CAST(PULocationID AS INT) AS PULocationID, pickup_datetime, trip_distance AS trip_miles, trip_time, total_amount, tip_amount AS tips, pickup_borough, pickup_zone,
        'yellow' AS source, "high_SES_count" > 0 AS "is_high_SES" FROM yellow_trips LEFT JOIN ses ON ses.id = DOLocationID""",
    "demand_ses": demand_sql(
        "flagged",
        False,
        ', count(*) FILTER (WHERE "is_high_SES") AS "trips_to_high_SES", ' + r('count(*) FILTER (WHERE "is_high_SES") / count(*)', 2) + ' AS "trips_to_high_SES_pct"',
    ),
    "sales_clean": SALES_CLEAN,
    "price_cap": "SELECT min(p) AS cap FROM (SELECT price_per_sqft AS p, count(*) OVER (ORDER BY price_per_sqft) AS upto, count(*) OVER () AS n FROM sales_clean) WHERE upto >= 0.95::DOUBLE * n",
    "zone_sales": """SELECT taxi_zone_id, avg(p) AS mean_price_per_sqft, quantile_disc(p, 0.5) AS median_price_per_sqft, count(*) AS num_sells
        FROM (SELECT taxi_zone_id, least(price_per_sqft, cap) AS p FROM sales_clean, price_cap) GROUP BY 1""",
    "wealth_base": """SELECT d.*, ses."low_SES_density", mean_price_per_sqft, median_price_per_sqft, num_sells FROM demand_ses d
        LEFT JOIN ses ON ses.id = PULocationID LEFT JOIN zone_sales ON taxi_zone_id = PULocationID""",
}


def ses(spark, sf):
    return places.ses_index(inputs.ses_pois(spark, sf), inputs.zone_areas(spark, sf))


def flagged_trips(spark, sf):
    trips = enrich.flag_high_ses(inputs.yellow_trips(spark, sf), ses(spark, sf))
    return trips.withColumnsRenamed({"trip_distance": "trip_miles", "tip_amount": "tips"}).withColumn(
        "PULocationID", F.col("PULocationID").cast("int")
    )


def zone_sales(spark, sf):
    return levels.sales_by_zone(quality.clean_sales(scanned_sales(spark, sf)))


def wealth_base(spark, sf):
    """Zone table of the index, stored once: its four weightings read it again."""

    def write(path):
        demand = rollups.zone_demand_ses(flagged_trips(spark, sf))
        levels.wealth_inputs(demand, ses(spark, sf), zone_sales(spark, sf)).write.parquet(path)

    return inputs.landed(spark, sf, "wealth_base", write)


@register(
    "ses_index",
    query(
        'SELECT id, zone, borough, area_miles2, "high_SES_count", "low_SES_count", '
        + ", ".join(f"{r(e, 6)} AS \"{n}\"" for n, e in {
            "high_SES_density": '"high_SES_density"', "low_SES_density": '"low_SES_density"',
            "SES_index": '("high_SES_density" - "low_SES_density")', "SES_index_corrected": '("high_SES_density" + "low_SES_density")',
        }.items())
        + " FROM ses",
        WEALTH,
    ),
)
def ses_index(spark, sf):
    index = ses(spark, sf).withColumn("SES_index_corrected", F.col("high_SES_density") + F.col("low_SES_density"))
    return rounded(index, high_SES_density=6, low_SES_density=6, SES_index=6, SES_index_corrected=6)


@register(
    "trips_high_ses",
    query('SELECT DOLocationID, "is_high_SES", count(*) AS trips FROM (SELECT y.DOLocationID, "high_SES_count" > 0 AS "is_high_SES" FROM yellow_trips y LEFT JOIN ses ON ses.id = y.DOLocationID) GROUP BY 1, 2', WEALTH),
)
def trips_high_ses(spark, sf):
    return flagged_trips(spark, sf).groupBy("DOLocationID", "is_high_SES").agg(F.count(F.lit(1)).alias("trips"))


@register("zone_demand_ses", query("SELECT * FROM demand_ses", WEALTH))
def zone_demand_ses(spark, sf):
    return rollups.zone_demand_ses(flagged_trips(spark, sf))


@register(
    "sales_by_zone",
    query(f"SELECT taxi_zone_id, {r('mean_price_per_sqft', 6)} AS mean_price_per_sqft, {r('median_price_per_sqft', 6)} AS median_price_per_sqft, num_sells FROM zone_sales", WEALTH),
)
def sales_by_zone(spark, sf):
    return rounded(zone_sales(spark, sf), mean_price_per_sqft=6, median_price_per_sqft=6)


@register(
    "wealth_inputs",
    query(
        'SELECT PULocationID, avg_daily_pickups, median_fare, "trips_to_high_SES_pct", '
        + ", ".join(f"{r(c, 6)} AS {c}" for c in ('"low_SES_density"', "mean_price_per_sqft", "median_price_per_sqft"))
        + ", num_sells FROM wealth_base",
        WEALTH,
    ),
)
def wealth_inputs(spark, sf):
    df = wealth_base(spark, sf).select(
        "PULocationID", "avg_daily_pickups", "median_fare", "trips_to_high_SES_pct", "low_SES_density",
        "mean_price_per_sqft", "median_price_per_sqft", "num_sells",
    )
    return rounded(df, low_SES_density=6, mean_price_per_sqft=6, median_price_per_sqft=6)


WEALTH_EXTRA = {
    "yellow": "true", "fhvhv": "true", "pois": '"low_SES_density" > -90', "full": "num_sells > 5",
}


def wealth_sql(kind):
    parts = " + ".join(norm_sql(f'"{c}"') + f" * {w}" for c, w in levels.WEALTH_WEIGHTS[kind].items())
    return (
        f"SELECT '{kind}' AS kind, PULocationID, {r(f'({parts})', 6)} AS wealth_index FROM wealth_base "
        f"WHERE avg_daily_pickups > 2 AND pickup_zone NOT LIKE '%Airport%' AND {WEALTH_EXTRA[kind]}"
    )


@register("wealth_index", query(" UNION ALL ".join(wealth_sql(k) for k in levels.WEALTH_WEIGHTS), WEALTH))
def wealth_index(spark, sf):
    base = wealth_base(spark, sf)
    parts = [
        levels.wealth_index(base, kind, min_pickups=2.0).select(
            F.lit(kind).alias("kind"), "PULocationID", round_half_up(F.col("wealth_index"), 6).alias("wealth_index")
        )
        for kind in levels.WEALTH_WEIGHTS
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@register(
    "house_prices",
    query(f"SELECT PULocationID, {r('mean_price_per_sqft', 6)} AS mean_price_per_sqft, num_sells FROM wealth_base WHERE num_sells > 5 AND mean_price_per_sqft < 10000 AND pickup_borough = 'ASIA'", WEALTH),
)
def house_prices(spark, sf):
    df = levels.house_prices(wealth_base(spark, sf), borough="ASIA")
    return rounded(df.select("PULocationID", "mean_price_per_sqft", "num_sells"), mean_price_per_sqft=6)


# ---- statistics -------------------------------------------------------------

CORR_COLUMNS = ["tip_amount", "total_amount", "trip_distance", "trip_time"]


@register(
    "corr_matrix",
    query(" UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", {r(f'corr({a}, {b})', 6)} AS r FROM yellow_trips" for a in CORR_COLUMNS for b in CORR_COLUMNS)),
)
def corr_matrix(spark, sf):
    return rounded(stats.correlation_matrix(inputs.yellow_trips(spark, sf), CORR_COLUMNS), r=6)


@register(
    "stratified_sample",
    query(
        f"SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS stratum FROM events WHERE substr(md5('42|' || event_id), 1, 8) < '{int(0.05 * 2**32):08x}'"
    ),
)
def stratified_sample(spark, sf):
    events = inputs.table(spark, sf, "events")
    return stats.stratified_sample(events, ["event_id"], 0.05).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH").alias("stratum")
    )


@register(
    "stratified_sample_exact",
    "SELECT event_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || event_id), event_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n "
    "FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS stratum FROM events)) WHERE rn <= ceil(n * 0.05::DOUBLE)",
)
def stratified_sample_exact(spark, sf):
    events = inputs.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH").alias("stratum"))
    return stats.exact_stratified_sample(events, "stratum", ["event_id"], 0.05)


# ---- lookups ----------------------------------------------------------------

def demand(spark, sf):
    """The demand table that the lookups read, stored once."""
    return inputs.landed(spark, sf, "zone_demand", lambda path: rollups.zone_demand(inputs.all_trips(spark, sf)).write.parquet(path))


@register(
    "top_demand_zones",
    query(
        "SELECT * FROM (SELECT 'evening' AS choice, pickup_zone, pickup_borough, pickups_evening AS pickups, avg_daily_pickups AS total_trips, avg_tip_pct FROM zone_demand ORDER BY pickups_evening DESC, PULocationID LIMIT 5) "
        "UNION ALL SELECT * FROM (SELECT 'yellow', pickup_zone, pickup_borough, CAST(trips_yellow AS DOUBLE), CAST(trips_yellow AS DOUBLE), avg_tip_pct_yellow FROM zone_demand ORDER BY trips_yellow DESC, PULocationID LIMIT 5) "
        "UNION ALL SELECT * FROM (SELECT 'any', pickup_zone, pickup_borough, avg_daily_pickups, avg_daily_pickups, avg_tip_pct FROM zone_demand ORDER BY avg_daily_pickups DESC, PULocationID LIMIT 5)"
    ),
)
def top_demand_zones(spark, sf):
    df = demand(spark, sf)
    parts = [
        lookups.top_demand_zones(df, "evening").withColumn("choice", F.lit("evening")),
        lookups.top_demand_zones(df, "any", "yellow").withColumn("choice", F.lit("yellow")),
        lookups.top_demand_zones(df).withColumn("choice", F.lit("any")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "top_tip_zones",
    query(
        "SELECT * FROM (SELECT 'fhvhv' AS choice, pickup_zone, pickup_borough, avg_tip_pct_fhvhv AS avg_tip_pct, avg_tip_fhvhv AS avg_tip, CAST(trips_fhvhv AS DOUBLE) AS total_trips FROM zone_demand ORDER BY avg_tip_pct_fhvhv DESC NULLS LAST, PULocationID LIMIT 5) "
        "UNION ALL SELECT * FROM (SELECT 'any', pickup_zone, pickup_borough, avg_tip_pct, avg_tip, avg_daily_pickups FROM zone_demand ORDER BY avg_tip_pct DESC NULLS LAST, PULocationID LIMIT 5)"
    ),
)
def top_tip_zones(spark, sf):
    df = demand(spark, sf)
    return lookups.top_tip_zones(df, "fhvhv").withColumn("choice", F.lit("fhvhv")).unionByName(
        lookups.top_tip_zones(df).withColumn("choice", F.lit("any"))
    )


@register(
    "zone_details",
    query("SELECT pickup_zone, pickup_borough, avg_daily_pickups, yellow_share_pct, trips_fhvhv, avg_fare_fhvhv, avg_tip_fhvhv, avg_tip_pct_fhvhv, avg_trip_miles_fhvhv, avg_trip_time_secs_fhvhv FROM zone_demand WHERE lower(pickup_zone) LIKE '%tion_1%'"),
)
def zone_details(spark, sf):
    return lookups.zone_details(demand(spark, sf), "TION_1", "fhvhv")


BANDS = ("morning", "afternoon", "evening", "night")


@register(
    "insights_overview",
    query(
        " UNION ALL ".join(
            f"SELECT '{s}' AS service, CAST(sum(trips_{s}) AS BIGINT) AS total_trips, {r(f'avg(avg_fare_{s})', 2)} AS avg_fare, {r(f'avg(avg_tip_pct_{s})', 1)} AS avg_tip_pct, "
            f"{r(f'avg(avg_trip_miles_{s})', 1)} AS avg_trip_miles, {r(f'avg(avg_trip_time_secs_{s}) / 60', 1)} AS avg_trip_time_min, "
            f"{r(f'sum(avg_fare_{s} * trips_{s}) / sum(CASE WHEN avg_fare_{s} IS NOT NULL THEN trips_{s} END)', 2)} AS weighted_avg_fare, "
            f"{r(f'sum(avg_tip_pct_{s} * trips_{s}) / sum(CASE WHEN avg_tip_pct_{s} IS NOT NULL THEN trips_{s} END)', 1)} AS weighted_avg_tip_pct, "
            + ", ".join(f"CAST({r(f'sum(pickups_{b} * {share})', 0)} AS BIGINT) AS pickups_{b}" for b in BANDS)
            + " FROM zone_demand"
            for s, share in (("yellow", "(yellow_share_pct / 100)"), ("fhvhv", "(1 - yellow_share_pct / 100)"))
        )
    ),
)
def insights_overview(spark, sf):
    df = demand(spark, sf)
    return lookups.insights_overview(df, "yellow").withColumn("service", F.lit("yellow")).unionByName(
        lookups.insights_overview(df, "fhvhv").withColumn("service", F.lit("fhvhv"))
    )


@register(
    "overview_top_zones",
    query(
        f"SELECT PULocationID, pickup_zone, pickup_borough, {r('avg_daily_pickups * (1 - yellow_share_pct / 100)', 6)} AS avg_daily_pickups, avg_fare_fhvhv AS avg_fare, avg_tip_fhvhv AS avg_tip, "
        "avg_tip_pct_fhvhv AS avg_tip_pct, avg_trip_miles_fhvhv AS avg_trip_miles, avg_trip_time_secs_fhvhv AS avg_trip_time_secs, pickups_morning, pickups_afternoon, pickups_evening, pickups_night "
        "FROM zone_demand ORDER BY trips_fhvhv DESC, PULocationID LIMIT 15"
    ),
)
def overview_top_zones(spark, sf):
    return rounded(lookups.overview_top_zones(demand(spark, sf), "fhvhv"), avg_daily_pickups=6)


# ---- tips -------------------------------------------------------------------

PROBS = lookups.PROBABILITIES
MEANS = ", ".join(f"avg({p}) AS {p}" for p in PROBS)
EXPECTED = " + ".join(f"coalesce({p}, 0) * {v}" for p, v in zip(PROBS, TIP_VALUES))
HIGHEST = f"greatest({', '.join(PROBS)})"
TOP_CATEGORY = "CASE " + " ".join(f"WHEN {p} = {HIGHEST} THEN '{l}'" for p, l in zip(PROBS, TIP_LABELS)) + " ELSE '$0' END"
EXPECTED_TIPS = {
    "zone_means": f"SELECT zone_id, {MEANS} FROM tip_scores GROUP BY 1",
    "expected": f"SELECT z.LocationID AS zone_id, z.Zone AS zone_name, z.Borough AS borough, {', '.join('m.' + p for p in PROBS)}, {TOP_CATEGORY} AS top_category, {EXPECTED} AS expected_tip_usd "
    "FROM zones z LEFT JOIN zone_means m ON m.zone_id = z.LocationID",
}
EXPECTED_SELECT = "SELECT zone_id, zone_name, borough, top_category, " + ", ".join(f"{r(c, 6)} AS {c}" for c in PROBS + ["expected_tip_usd"]) + " FROM expected"


def expected(spark, sf):
    return lookups.expected_tip_by_zone(inputs.tip_scores(spark, sf), inputs.zones(spark, sf))


def expected_rounded(df):
    return rounded(df, expected_tip_usd=6, **{p: 6 for p in PROBS})


@register("tip_expected_by_zone", query(EXPECTED_SELECT, EXPECTED_TIPS))
def tip_expected_by_zone(spark, sf):
    return expected_rounded(lookups.sort_by_expected_tip(expected(spark, sf)))


@register("tip_by_zone_name", query(EXPECTED_SELECT + " WHERE lower(zone_name) LIKE '%airport%'", EXPECTED_TIPS))
def tip_by_zone_name(spark, sf):
    return expected_rounded(lookups.tip_by_zone_name(expected(spark, sf), "Airport"))


BASELINE = {
    "zone_tip": "SELECT PULocationID, avg(tip_amount) AS predicted_tip FROM yellow_trips WHERE pickup_datetime < TIMESTAMP '2024-01-20' GROUP BY 1",
    "judged": f"SELECT t.*, predicted_tip, CASE WHEN predicted_tip IS NULL THEN 4 ELSE {tip_cat('predicted_tip')} END AS predicted_category FROM yellow_trips t LEFT JOIN zone_tip USING (PULocationID) WHERE pickup_datetime >= TIMESTAMP '2024-01-20'",
}


@register(
    "tip_baseline",
    query(
        "SELECT CAST(tip_category AS INT) AS tip_category, CAST(predicted_category AS INT) AS predicted_category, count(*) AS trips, "
        f"{r('sum(count(*) FILTER (WHERE tip_category = predicted_category)) OVER () / sum(count(*)) OVER ()', 6)} AS accuracy FROM judged GROUP BY 1, 2",
        BASELINE,
    ),
)
def tip_baseline(spark, sf):
    train, test = quality.time_split(inputs.yellow_trips(spark, sf), "2024-01-20")
    predictions = enrich.tip_baseline(train, test)
    accuracy = enrich.top1_accuracy(predictions).select("accuracy").scalar()
    return (
        predictions.groupBy("tip_category", "predicted_category")
        .agg(F.count(F.lit(1)).alias("trips"))
        .withColumn("accuracy", round_half_up(accuracy, 6))
    )


# ---- scoring ----------------------------------------------------------------

ARGMAX = "CASE " + " ".join(f"WHEN {p} = {HIGHEST} THEN {i}" for i, p in enumerate(PROBS)) + " END"
SORTED = f"list_reverse_sort([{', '.join(PROBS)}])"
TRUE_P = f"[{', '.join(PROBS)}][tip_category + 1]"


def scored(spark, sf):
    return inputs.tip_scores(spark, sf).withColumn("prediction", scoring.predicted_class(PROBS))


@register(
    "top_n_accuracy",
    query(
        " UNION ALL ".join(
            f"SELECT CAST({n} AS INT) AS n, count(*) FILTER (WHERE {TRUE_P} >= {SORTED}[{n}]) AS hits, {r(f'count(*) FILTER (WHERE {TRUE_P} >= {SORTED}[{n}]) / (count(*) + 7)', 6)} AS accuracy FROM tip_scores"
            for n in (1, 2, 3)
        )
    ),
)
def top_n_accuracy(spark, sf):
    df = scoring.top_n_accuracy(inputs.tip_scores(spark, sf), "tip_category", PROBS, missed=7)
    return rounded(df, accuracy=6)


@register(
    "confusion_matrix",
    query(
        "SELECT tip_category AS label, "
        + ", ".join(f"count(*) FILTER (WHERE p = {c}) AS predicted_{c}" for c in range(5))
        + f" FROM (SELECT *, {ARGMAX} AS p FROM tip_scores) GROUP BY 1"
    ),
)
def confusion_matrix(spark, sf):
    return scoring.confusion_matrix(scored(spark, sf), "tip_category", "prediction", list(range(5)))


@register(
    "accuracy_by_hour",
    query(f"SELECT pickup_hour, {r(f'avg(CASE WHEN tip_category = {ARGMAX} THEN 1.0 ELSE 0.0 END)', 6)} AS accuracy, count(*) AS rows FROM tip_scores GROUP BY 1"),
)
def accuracy_by_hour(spark, sf):
    return rounded(scoring.accuracy_by(scored(spark, sf), "pickup_hour", "tip_category", "prediction"), accuracy=6)


@register(
    "prob_hist",
    query(
        " UNION ALL ".join(f"SELECT '{p}' AS class, CAST(least(floor({p} * 30), 29) AS INT) AS bin, count(*) AS rows FROM tip_scores GROUP BY 2" for p in PROBS)
    ),
)
def prob_hist(spark, sf):
    return scoring.probability_histogram(inputs.tip_scores(spark, sf), PROBS)


METRICS = {
    "argmaxed": f"SELECT tip_category AS l, {ARGMAX} AS p, {TRUE_P} AS tp FROM tip_scores",
    "per_class": "SELECT c AS class, count(*) FILTER (WHERE l = c) AS actual, count(*) FILTER (WHERE p = c) AS predicted, count(*) FILTER (WHERE l = c AND p = c) AS correct FROM argmaxed, (SELECT unnest(range(5)) AS c) GROUP BY 1 HAVING count(*) FILTER (WHERE l = c OR p = c) > 0",
    "ratios": "SELECT *, coalesce(correct / nullif(predicted, 0), 0) AS precision, coalesce(correct / nullif(actual, 0), 0) AS recall FROM per_class",
}


@register(
    "classifier_metrics",
    query(
        f"SELECT CAST(class AS INT) AS class, actual, predicted, correct, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, "
        f"{r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)', 6)} AS f1, "
        f"(SELECT {r('avg(CASE WHEN l = p THEN 1.0 ELSE 0.0 END)', 6)} FROM argmaxed) AS accuracy, "
        f"(SELECT {r('avg(-ln(greatest(least(tp, 1 - 1e-15), 1e-15)))', 6)} FROM argmaxed) AS log_loss FROM ratios",
        METRICS,
    ),
)
def classifier_metrics(spark, sf):
    scores = scored(spark, sf)
    overall = scoring.log_loss(scores, "tip_category", PROBS)
    df = scoring.class_metrics(scores, "tip_category", "prediction").withColumns(
        {c: overall.select(c).scalar() for c in ("accuracy", "log_loss")}
    )
    return rounded(df, precision=6, recall=6, f1=6, accuracy=6, log_loss=6)


@register(
    "classifier_auc",
    query(
        f"SELECT positives, others, {r('(ranks - positives * (positives + 1) / 2.0) / (positives * others::DOUBLE)', 9)} AS auc FROM ("
        "SELECT count(*) FILTER (hit) AS positives, count(*) FILTER (NOT hit) AS others, sum(rank) FILTER (hit) AS ranks FROM ("
        "SELECT tip_category > 0 AS hit, rank() OVER (ORDER BY prob_class_0 DESC) + (count(*) OVER (PARTITION BY prob_class_0) - 1) / 2.0 AS rank FROM tip_scores))"
    ),
)
def classifier_auc(spark, sf):
    scores = inputs.tip_scores(spark, sf).withColumn("tipped", -F.col("prob_class_0"))
    return rounded(scoring.area_under_curve(scores, F.col("tip_category") > 0, "tipped"), auc=9)


TOP2 = {
    "ranked": "SELECT event_id, i, p, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, i) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT event_id, {i} AS i, {p} AS p FROM tip_scores" for i, p in enumerate(PROBS))
    + ")",
    "paired": "SELECT event_id, min(i) AS a, max(i) AS b, arg_min(p, i) AS pa, arg_max(p, i) AS pb FROM ranked WHERE rn <= 2 GROUP BY 1",
}
LABEL_LIST = "['$0', '$1-2', '$2-3', '$3-5', '$5+']"


@register(
    "top2_label",
    query(
        f"SELECT event_id, CASE WHEN b - a = 1 THEN {LABEL_LIST}[a + 1] || ' & ' || {LABEL_LIST}[b + 1] || ': ' || {r('(pa + pb)', 4)} "
        f"ELSE {LABEL_LIST}[a + 1] || ': ' || {r('pa', 4)} || ' | ' || {LABEL_LIST}[b + 1] || ': ' || {r('pb', 4)} END AS top_predictions FROM paired",
        TOP2,
    ),
)
def top2_label(spark, sf):
    return inputs.tip_scores(spark, sf).select("event_id", scoring.top2_label(PROBS, digits=4).alias("top_predictions"))
