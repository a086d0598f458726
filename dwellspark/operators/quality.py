"""Coordinate checks and quality scoring over a sales DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dwellspark.functions import geo, text
from dwellspark.lineage import cut_lineage


def region_check(df: DataFrame, regions: DataFrame, county: str = "county") -> DataFrame:
    """Add `region_ok`: inside any ring of the stated region; unknown regions pass.

    `regions` is (region, rings ARRAY<ARRAY<STRUCT<lat, lon>>>), one row per
    administrative area, so its size is fixed by geography and not by the data."""
    hit = F.exists("rings", lambda ring: geo.point_in_polygon(F.col("latitude"), F.col("longitude"), ring))
    return (df.join(regions, F.initcap(F.trim(county)) == F.col("region"), "left")
            .withColumn("region_ok", F.when(F.col("region").isNull(), True).otherwise(hit))
            .drop("region", "rings"))


def county_check(df: DataFrame, margin: float = 0.2) -> DataFrame:
    """Add `county_ok`, `padded_ok` and, when outside, the `candidates` boxes."""
    name = text.normalize_county("county")
    ok = F.coalesce(geo.in_county_box("latitude", "longitude", name), F.lit(True))
    padded = F.coalesce(geo.in_county_box("latitude", "longitude", name, margin), F.lit(True))
    return (df.withColumn("county_ok", ok).withColumn("padded_ok", padded)
            .withColumn("candidates", F.when(F.col("county_ok"), F.array().cast("array<string>"))
                        .otherwise(geo.candidate_counties("latitude", "longitude"))))


# ------------------------------------------------------------ scoring and choice

# Acceptance bounds of the coordinate rules.
MIN_SCORE, SCORE_MARGIN, SHARED_ROWS = 20, 10, 50
ROUTING_KEY_MAX_KM, COUNTY_MARGIN = 40.0, 0.2
SUSPECT_CLUSTER, WORKLIST_CLUSTER, MIN_KEY_POINTS = 50, 30, 20


def _point_key(df: DataFrame) -> list:
    return [geo.round_to("latitude", 6).alias("_la"), geo.round_to("longitude", 6).alias("_lo")]


def crowded_points(*sources: DataFrame, min_rows: int = SHARED_ROWS) -> DataFrame:
    """6-decimal points used by at least `min_rows` rows over all sources."""
    both = None
    for s in sources:
        part = s.where("latitude is not null and longitude is not null").select(*_point_key(s))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("_la", "_lo").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min_rows)


def score_coordinates(df: DataFrame, points: DataFrame) -> DataFrame:
    """Add `score` (0..100) and the `issues` list; `points` from `crowded_points`."""
    lat, lon = F.col("latitude"), F.col("longitude")
    missing = lat.isNull() | lon.isNull() | (lat == 0) | (lon == 0)
    la, lo = _point_key(df)
    df = (df.withColumn("_la", la).withColumn("_lo", lo)
          .join(points.select("_la", "_lo", F.lit(True).alias("_shared")), ["_la", "_lo"], "left"))
    shared = F.coalesce("_shared", F.lit(False))
    county = text.normalize_county("county")
    mismatch = ~F.coalesce(geo.in_county_box(lat, lon, county), F.lit(True))
    dlat, dlon = geo.decimals(lat), geo.decimals(lon)
    fine, coarse = (dlat >= 6) & (dlon >= 6), (dlat <= 3) | (dlon <= 3)
    raw = (F.lit(100) - F.when(shared, 80).otherwise(0) - F.when(mismatch, 50).otherwise(0)
           + F.when(fine, 5).when(coarse, -10).otherwise(0))
    score = (F.when(missing, 0).when(~geo.in_bounds(lat, lon), 0)
             .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw))))
    issues = (F.when(missing, F.array(F.lit("Missing coordinates")))
              .when(~geo.in_bounds(lat, lon), F.array(F.lit("Out of bounds")))
              .otherwise(F.array_compact(F.array(
                  F.when(shared, F.lit("Known centroid coordinate")), F.when(mismatch, F.lit("County mismatch")),
                  F.when(fine, F.lit("High precision (good)")).when(coarse, F.lit("Low precision"))))))
    return df.withColumn("score", score).withColumn("issues", issues).drop("_la", "_lo", "_shared")


def choose_coordinates(base: DataFrame, other: DataFrame) -> DataFrame:
    """One decision per upper-cased address of the base (its highest id decides):
    which source's coordinate to keep, why, and what changes."""
    located = base.where("latitude is not null and longitude is not null")
    points = crowded_points(located, other)
    key = F.upper(F.trim("address")).alias("address_key")
    last = (located.groupBy(key).agg(F.max_by(F.struct("id", "address", "county", "latitude", "longitude"), "id").alias("r"))
            .select("address_key", "r.*"))
    second = (other.groupBy(key).agg(F.max(F.struct("latitude", "longitude", "county")).alias("r"))
              .select("address_key", F.col("r.latitude").alias("s_lat"), F.col("r.longitude").alias("s_lon"),
                      F.col("r.county").alias("s_county"), F.lit(True).alias("_both")))
    both = last.join(second, "address_key", "left").withColumn("county", F.coalesce("county", "s_county"))
    scored = (score_coordinates(both, points).withColumnsRenamed(
        {"score": "base_score", "issues": "base_issues", "latitude": "base_lat", "longitude": "base_lon"})
        .withColumnsRenamed({"s_lat": "latitude", "s_lon": "longitude"}))
    scored = score_coordinates(scored, points).withColumnsRenamed(
        {"score": "second_score", "issues": "second_issues", "latitude": "second_lat", "longitude": "second_lon"})
    b, s = F.col("base_score"), F.col("second_score")
    have = F.coalesce("_both", F.lit(False))
    chosen = (F.when(~have, F.when(b >= MIN_SCORE, "base").otherwise("none"))
              .when((b < MIN_SCORE) & (s < MIN_SCORE), "none").when(s < MIN_SCORE, "base")
              .when(b < MIN_SCORE, "second").when(b > s + SCORE_MARGIN, "base").otherwise("second"))
    scores = F.concat(F.lit("("), b.cast("string"), F.lit(" vs "), s.cast("string"), F.lit(")"))
    reason = (F.when(~have, "base only").when((b < MIN_SCORE) & (s < MIN_SCORE), "both sources low")
              .when(s < MIN_SCORE, "base better").when(b < MIN_SCORE, "second better")
              .when(s > b + SCORE_MARGIN, "second higher quality").when(b > s + SCORE_MARGIN, "base higher quality")
              .otherwise("second preferred, similar scores"))
    out = scored.withColumn("second_score", F.when(have, s).otherwise(0)).select(
        "id", "address", "county", "base_lat", "base_lon", "base_score", "base_issues",
        "second_lat", "second_lon", "second_score", "second_issues",
        chosen.alias("chosen_source"), F.concat_ws(" ", reason, scores).alias("reason"))
    src = F.col("chosen_source")
    out = (out.withColumn("chosen_lat", F.when(src == "base", F.col("base_lat")).when(src == "second", F.col("second_lat")))
           .withColumn("chosen_lon", F.when(src == "base", F.col("base_lon")).when(src == "second", F.col("second_lon"))))
    moved = (F.col("chosen_lat") != F.col("base_lat")) | (F.col("chosen_lon") != F.col("base_lon"))
    return out.withColumn("change", F.when(src == "none", "nullify").when(moved, "update").otherwise("no_change"))


def flag_geocodes(df: DataFrame, stats: DataFrame, min_key_points: int = MIN_KEY_POINTS,
                  suspect_at: int = SUSPECT_CLUSTER, worklist_at: int = WORKLIST_CLUSTER) -> DataFrame:
    """Set `geocode_suspect` and `needs_geocoding` exactly, with the rule columns.

    Each row gets its rules as columns in one pass. `stats` has at most one row per
    valid routing key (a key space of 2,860), so it is broadcast."""
    keys = (stats.where((F.col("geocoded_count") >= min_key_points) & F.col("centroid_lat").isNotNull())
            .select("routing_key", "centroid_lat", "centroid_lon"))
    crowded = (df.where("latitude is not null").groupBy("latitude", "longitude")
               .agg(F.countDistinct("address").alias("_crowd")).where(F.col("_crowd") >= worklist_at))
    located = F.col("latitude").isNotNull()
    far = (geo.haversine_m("latitude", "longitude", "centroid_lat", "centroid_lon") / 1000.0) > ROUTING_KEY_MAX_KM
    rows = (df.join(keys, "routing_key", "left")
            .join(crowded, ["latitude", "longitude"], "left")
            .withColumn("county_bad", located & ~F.coalesce(
                geo.in_county_box("latitude", "longitude", "county", COUNTY_MARGIN), F.lit(True)))
            .withColumn("key_bad", F.coalesce(far, F.lit(False)))
            .withColumn("crowd_suspect", F.coalesce(F.col("_crowd") >= suspect_at, F.lit(False)))
            .withColumn("crowd_worklist", F.col("_crowd").isNotNull()))
    bad = F.col("county_bad") | F.col("key_bad")
    return (rows.withColumn("geocode_suspect", bad | F.col("crowd_suspect"))
            .withColumn("needs_geocoding", F.col("latitude").isNull() | bad | F.col("crowd_worklist"))
            .drop("centroid_lat", "centroid_lon", "_crowd"))


def refresh_flags(register: DataFrame, new: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, geocode_suspect, needs_geocoding) of the rows whose flags the delivery `new`, already part of `register`, can
    change: its own rows, those of routing keys whose centroid it moves and those on coordinates it adds to.

    Only located rows of a delivery move anything. Crowds are counted on the coordinates of these rows alone."""
    spot = ["latitude", "longitude"]
    located = new.where("latitude is not null")
    of_key = register.join(located.where("routing_key is not null").select("routing_key").distinct(), "routing_key", "left_semi")
    on_spot = register.join(located.select(*spot).distinct(), spot, "left_semi")
    touched = cut_lineage(reduce(DataFrame.union, [d.select("id", *spot) for d in (of_key, on_spot, new)]).distinct())
    spots = touched.where("latitude is not null").select(*spot).distinct()
    around = register.join(spots, spot, "left_semi").unionByName(
        register.where("latitude is null").join(touched.select("id"), "id", "left_semi"))
    return (flag_geocodes(around, stats).join(touched.select("id"), "id", "left_semi")
            .select("id", "geocode_suspect", "needs_geocoding"))


def _candidate_rows(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    keys = stats.where("centroid_lat is not null").select("routing_key", "centroid_lat", "centroid_lon")
    return candidates.join(keys, "routing_key", "left")


def validate_candidates(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """Judge geocoder candidates (id, cand_lat, cand_lon, feature_type, precision,
    county, routing_key): hard rejects, then a quality; accepted from 70."""
    lat, lon = F.col("cand_lat"), F.col("cand_lon")
    county = text.normalize_county("county")
    km = geo.haversine_m(lat, lon, "centroid_lat", "centroid_lon") / 1000.0
    kind, precision = F.col("feature_type"), F.col("precision")
    quality = (F.when(kind == "address", F.when(precision == "rooftop", 100).when(precision == "parcel", 90).otherwise(80))
               .when(kind == "postcode", 85).when(kind.isin("poi", "street"), 75).when(kind.isin("locality", "place"), 70))
    reason = (F.when(lat.isNull() | lon.isNull(), "no_result")
              .when(~geo.in_bounds(lat, lon), "out_of_bounds")
              .when(F.coalesce(km > ROUTING_KEY_MAX_KM, F.lit(False)), "routing_key_far")
              .when(~F.coalesce(geo.in_county_box(lat, lon, county, COUNTY_MARGIN), F.lit(True)), "wrong_county")
              .when(quality.isNull(), F.concat(F.lit("feature_type_"), kind)).otherwise("validated"))
    inside = F.coalesce(geo.in_county_box(lat, lon, county), F.lit(True))
    return (_candidate_rows(candidates, stats).withColumn("reason", reason)
            .withColumn("quality", F.when(F.col("reason") != "validated", 0)
                        .when(inside, quality).otherwise(F.least(quality, F.lit(70))))
            .withColumn("accepted", F.col("quality") >= 70).drop("centroid_lat", "centroid_lon"))


def check_register_coordinates(df: DataFrame) -> DataFrame:
    """Lenient check at import: bounds and near-zero values only."""
    lat, lon = F.col("latitude"), F.col("longitude")
    reason = (F.when(lat.isNull() | lon.isNull(), "no_coordinates").when(~geo.in_bounds(lat, lon), "out_of_bounds")
              .when((F.abs(lat) < 1) | (F.abs(lon) < 1), "suspicious_zero").otherwise("ok"))
    ok = F.col("check") == "ok"
    return (df.withColumn("check", reason).withColumn("latitude", F.when(ok, lat)).withColumn("longitude", F.when(ok, lon)))


def validate_by_degree_gap(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """Variant for postcode geocoders: reject outside the country or off the routing
    key's degree gap; 100 with key, 90 with county, 80 without one, 70 off-county."""
    lat, lon, county = F.col("cand_lat"), F.col("cand_lon"), text.normalize_county("county")
    near = geo.degree_gap_ok(lat, lon, "centroid_lat", "centroid_lon")
    inside = F.coalesce(geo.in_county_box(lat, lon, county), F.lit(True))
    reject = lat.isNull() | lon.isNull() | ~geo.in_bounds(lat, lon) | F.coalesce(~near, F.lit(False))
    score = (F.when(reject, 0).when(F.coalesce(near, F.lit(False)), 100)
             .when(F.coalesce("county", F.lit("")) == "", 80).when(inside, 90).otherwise(70))
    return (_candidate_rows(candidates, stats).withColumn("quality", score)
            .withColumn("gap_km", geo.degree_gap_km(lat, lon, "centroid_lat", "centroid_lon"))
            .drop("centroid_lat", "centroid_lon"))


# ------------------------------------------------------------ reports

# Report thresholds and the columns whose completeness is reported.
THRESHOLDS = {"centroid_pct": 5.0, "needs_geocoding": 5000, "recent_geocode_pct": 98.0, "duplicate_rows": 2000,
              "county_count": 26, "oob_coords": 0, "unflagged_outliers": 2000}
COMPLETENESS = ["latitude", "longitude", "eircode", "address", "address_normalized", "sale_date", "price",
                "county", "property_type", "bedrooms", "routing_key"]


def quality_report(df: DataFrame, as_of: str, thresholds: dict | None = None, since: str = "2021-01-01",
                   crowded: int = 100) -> DataFrame:
    """Nine checks as (name, status, detail, metrics MAP<STRING, DOUBLE>).

    One wide aggregate gives most metrics; the others are bounded aggregates joined
    in as scalar subqueries."""
    from dwellspark.operators.joins import with_scalars
    from dwellspark.operators.quantiles import grouped_quantiles
    from dwellspark.operators.stats import at_shared_points, duplicate_groups

    t = {**THRESHOLDS, **(thresholds or {})}
    outlier = (F.col("price") < 10_000) | (F.col("price") > 20_000_000)
    located = F.col("latitude").isNotNull()
    wide = df.agg(
        F.count("*").alias("total"), *[F.count(c).alias(f"has_{c}") for c in COMPLETENESS],
        F.count_if(located & ~geo.in_bounds("latitude", "longitude")).alias("out_of_bounds"),
        F.count_if("needs_geocoding").alias("needs_geocoding"),
        F.min("price").cast("double").alias("min_price"), F.max("price").cast("double").alias("max_price"),
        (F.sum("price").cast("double") / F.count("price")).alias("avg_price"),
        F.count_if(F.col("price") < 10_000).alias("below_10k"), F.count_if(F.col("price") > 20_000_000).alias("above_20m"),
        F.count_if(outlier & ~F.col("not_full_market_price")).alias("unflagged_outliers"),
        F.count_if(F.col("sale_date") > F.lit(as_of).cast("date")).alias("future_dated"),
        F.count_if(F.col("sale_date") < F.lit("2010-01-01").cast("date")).alias("before_2010"),
        F.min("sale_date").alias("min_date"), F.max("sale_date").alias("max_date"),
        F.count_if(F.upper(F.substring("eircode", 1, 3)) != F.col("routing_key")).alias("routing_key_mismatch"),
        F.count_if(text.postcode_malformed("eircode")).alias("malformed_eircode"))
    counties = df.groupBy("county").agg(F.count("*").alias("c")).agg(F.count("county").alias("distinct_counties"))
    hit = at_shared_points(df, crowded).agg(F.count("*").alias("centroid_rows"))
    median = grouped_quantiles(df, [], "price", {"median_price": 0.5}, stats=False)
    sources = (df.where("property_type is not null").groupBy(F.coalesce("property_type_source", F.lit("none")).alias("s"))
               .agg(F.count("*").cast("double").alias("c"))
               .agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("by_source")))
    yearly = (df.where(F.col("sale_date") >= F.lit(since).cast("date")).groupBy(F.year("sale_date").alias("y"))
              .agg(geo.round_to(F.count("latitude") * 100.0 / F.count("*"), 1).alias("p"))
              .agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("pct_"), F.col("y").cast("string")), "p")))
                   .alias("by_year"), F.max("y").alias("current_year"), F.max_by("p", "y").alias("current_year_pct")))
    one = wide
    for part in (counties, hit, median, duplicate_groups(df), sources, yearly):
        one = with_scalars(one, part)
    c = F.col
    one = one.withColumn("centroid_pct", geo.round_to(c("centroid_rows") * 100.0 / c("total"), 2))

    def metrics(*names):
        return F.create_map(*[x for n in names for x in (F.lit(n), c(n).cast("double"))])

    null_counts = F.create_map(F.lit("total_rows"), c("total").cast("double"), *[
        x for n in COMPLETENESS for x in (F.lit(f"null_{n}"), (c("total") - c(f"has_{n}")).cast("double"))])
    warn = lambda cond, other="ok": F.when(cond, "warn").otherwise(other)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    check = lambda name, status, detail, m: F.struct(
        F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"), m.alias("metrics"))
    checks = F.array(
        check("completeness", F.lit("info"), say("NULL counts over ", c("total"), " rows"), null_counts),
        check("geocoding_quality", F.when(c("out_of_bounds") > t["oob_coords"], "fail").when(
            (c("centroid_pct") > t["centroid_pct"]) | (c("needs_geocoding") > t["needs_geocoding"]), "warn").otherwise("ok"),
            say(c("out_of_bounds"), " out of bounds; ", c("centroid_rows"), " at shared points; needs_geocoding=", c("needs_geocoding")),
            metrics("out_of_bounds", "centroid_rows", "centroid_pct", "needs_geocoding")),
        check("price_sanity", warn(c("unflagged_outliers") > t["unflagged_outliers"]),
              say("min=", c("min_price"), " max=", c("max_price"), " median=", c("median_price")),
              metrics("min_price", "max_price", "avg_price", "median_price", "below_10k", "above_20m", "unflagged_outliers")),
        check("date_sanity", warn((c("future_dated") > 0) | (c("before_2010") > 0)),
              say("range ", c("min_date"), " to ", c("max_date")), metrics("future_dated", "before_2010")),
        check("duplicates", warn(c("redundant_rows") > t["duplicate_rows"], "info"),
              say(c("duplicate_groups"), " same-key groups; ", c("redundant_rows"), " redundant rows; legitimate, never deleted"),
              metrics("duplicate_groups", "redundant_rows")),
        check("county_distribution", warn(c("distinct_counties") != t["county_count"]),
              say(c("distinct_counties"), " distinct counties"), metrics("distinct_counties")),
        check("property_type_provenance", F.lit("info"), say(c("has_property_type"), " rows have a dwelling type"),
              F.map_concat(F.create_map(F.lit("populated"), c("has_property_type").cast("double")), c("by_source"))),
        check("eircode_consistency", warn((c("routing_key_mismatch") > 0) | (c("malformed_eircode") > 0)),
              say(c("routing_key_mismatch"), " key mismatches; ", c("malformed_eircode"), " malformed"),
              metrics("routing_key_mismatch", "malformed_eircode")),
        check("recent_geocode_coverage", warn(F.coalesce(c("current_year_pct"), F.lit(100.0)) < t["recent_geocode_pct"]),
              say("latest year located ", F.coalesce(c("current_year_pct"), F.lit(100.0)), "%"),
              F.map_concat(F.create_map(F.lit("current_year_pct"), c("current_year_pct")), c("by_year"))))
    return one.select(F.explode(checks).alias("c")).select("c.*")


def report_metrics(report: DataFrame) -> DataFrame:
    """Long numeric form of a report; this is what a snapshot stores."""
    return report.select("name", "status", F.explode("metrics").alias("metric", "value"))


def quality_trend(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Compare two metric snapshots: change, percentage and direction."""
    a = now.select("name", "metric", F.col("value").alias("now_value"))
    b = baseline.select("name", "metric", F.col("value").alias("base_value"))
    change = F.col("now_value") - F.col("base_value")
    return (a.join(b, ["name", "metric"], "full").withColumn("change", change)
            .withColumn("change_pct", F.when(F.col("base_value") != 0, geo.round_to(change * 100.0 / F.col("base_value"), 4)))
            .withColumn("trend", F.when(change < 0, "down").when(change > 0, "up").when(change == 0, "same")))
