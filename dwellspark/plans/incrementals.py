"""Registered queries: subscriptions, logs, rate limits, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.fixtures import API_USAGE_SQL, api_usage, dwelling_sales, table
from dwellspark.functions.geo import round_to
from dwellspark.operators import incremental, search
from dwellspark.operators.joins import for_each_request
from dwellspark.plans import sqltext as q
from dwellspark.plans.registry import over_sales, query
from dwellspark.plans.searches import _RADIUS_CTES, _radius_asks

# One subscription per customer with sales, on its street or on its full address.
_SUBS = """subs AS (SELECT k AS sub_id, concat('c', k, '@mail.ie') AS email, CASE WHEN k%3=0 THEN lower(min(address)) WHEN k%3=1 THEN concat('TOWN', k%40, ', ', min(county)) ELSE concat('no place ', k) END AS address,
  CAST(1 + k%4 AS DOUBLE) AS radius_km, CASE WHEN k%5=0 THEN min(county) END AS county, k%10 <> 0 AS is_active, TIMESTAMP '1999-01-01' AS created_at, CASE WHEN k%2=0 THEN TIMESTAMP '2000-06-01' END AS last_sent_at FROM dwelling GROUP BY k),
  arrivals AS (SELECT *, CAST(sale_date AS TIMESTAMP) + INTERVAL 14 DAY AS arrived FROM dwelling)"""


def subscriptions(s):
    k = F.col("k")
    return s.groupBy("k").agg(F.min("address").alias("a"), F.min("county").alias("c")).select(
        k.alias("sub_id"), F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.ie")).alias("email"),
        F.when(k % 3 == 0, F.lower("a")).when(k % 3 == 1, F.concat(F.lit("TOWN"), (k % 40).cast("string"), F.lit(", "), F.col("c")))
        .otherwise(F.concat(F.lit("no place "), k.cast("string"))).alias("address"),
        (1 + k % 4).cast("double").alias("radius_km"), F.when(k % 5 == 0, F.col("c")).alias("county"), (k % 10 != 0).alias("is_active"),
        F.lit("1999-01-01").cast("timestamp").alias("created_at"), F.when(k % 2 == 0, F.lit("2000-06-01").cast("timestamp")).alias("last_sent_at"))


def arrived_sales(s):
    return s.withColumn("created_at", F.date_add("sale_date", 14).cast("timestamp"))


def _alerts(match: str, name: str) -> None:
    test = "contains(lower(s.address), lower(u.address))" if match == "contains" else "starts_with(lower(s.address), lower(u.address))"
    dist = q.haversine("la", "lo", "latitude", "longitude")

    @query(name, over_sales(
        f"""SELECT sub_id, id, CAST(row_number() OVER (PARTITION BY sub_id ORDER BY sale_date DESC, id) AS INT) AS position, round({dist} / 1000, 4) AS distance_km FROM
          (SELECT u.*, p.la, p.lo FROM subs u JOIN (SELECT sub_id AS sid, arg_min(latitude, id) AS la, arg_min(longitude, id) AS lo FROM subs u JOIN dwelling s ON {test} WHERE latitude IS NOT NULL AND is_active GROUP BY 1) p ON sid = sub_id) u
          JOIN (SELECT id, sale_date, latitude, longitude, county AS sc, arrived FROM arrivals WHERE latitude IS NOT NULL AND NOT not_full_market_price) s ON arrived > coalesce(last_sent_at, created_at) AND (u.county IS NULL OR u.county = sc) AND abs(latitude - la) < 0.06 AND {dist} <= radius_km * 1000 QUALIFY position <= 50""", _SUBS))
    def _(spark, d):
        s = arrived_sales(dwelling_sales(spark, d))
        return incremental.match_alerts(subscriptions(s), s, match=match).select(
            "sub_id", "id", "position", round_to("distance_km", 4).alias("distance_km"))


_alerts("contains", "match_alerts")
_alerts("prefix", "match_alerts_by_prefix")

_EVENTS = """base_subs AS (SELECT concat('u', user_id, '@x.ie') AS email, 'Home' AS address, 1.0::DOUBLE AS radius_km, NULL::VARCHAR AS county, user_id%2=0 AS is_active, TIMESTAMP '2023-01-01' AS created_at, concat('t', user_id) AS token FROM (SELECT DISTINCT user_id FROM events WHERE user_id%3=0)),
  ev AS (SELECT ts, CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'error' THEN 'unsubscribe' END AS kind, concat('u', user_id, '@x.ie') AS email, CASE WHEN event_id%2=0 THEN 'Home' ELSE 'Work' END AS address, CAST(1 + event_id%5 AS DOUBLE) AS radius_km, CASE WHEN event_id%4=0 THEN 'Dublin' END AS county,
    CASE WHEN user_id%3=0 AND event_id%2=0 THEN concat('t', user_id) ELSE sha256(concat('u', user_id, '@x.ie|', CASE WHEN event_id%2=0 THEN 'Home' ELSE 'Work' END)) END AS token FROM events WHERE event_type IN ('signup', 'error'))"""


@query("upsert_subscription", f"""WITH {_EVENTS}, s AS (SELECT email, address, max(ts) AS sts, arg_max(radius_km, ts) AS r, arg_max(county, ts) FILTER (true) AS c0, arg_max(coalesce(county, '~'), ts) AS c FROM ev WHERE kind = 'subscribe' GROUP BY ALL),
  u AS (SELECT token, max(ts) AS off FROM ev WHERE kind = 'unsubscribe' GROUP BY 1), m AS (SELECT coalesce(b.email, s.email) AS email, coalesce(b.address, s.address) AS address, coalesce(b.token, sha256(concat(s.email, '|', s.address))) AS token, b.radius_km AS br, is_active, b.created_at AS bc, sts, r, nullif(c, '~') AS c, b.county AS bcounty FROM base_subs b FULL JOIN s ON b.email = s.email AND b.address = s.address)
SELECT email, address, CASE WHEN sts IS NOT NULL THEN r ELSE br END AS radius_km, CASE WHEN sts IS NOT NULL THEN c ELSE bcounty END AS county, (CASE WHEN sts IS NOT NULL THEN true ELSE is_active END) AND NOT coalesce(off > coalesce(sts, TIMESTAMP '1970-01-01'), false) AS is_active, coalesce(sts, bc) AS created_at FROM m LEFT JOIN u USING (token)""")
def _(spark, d):
    e = table(spark, d, "events")
    user, i = F.col("user_id"), F.col("event_id")
    mail = F.concat(F.lit("u"), user.cast("string"), F.lit("@x.ie"))
    base = e.where("user_id % 3 = 0").select("user_id").distinct().select(
        mail.alias("email"), F.lit("Home").alias("address"), F.lit(1.0).alias("radius_km"), F.lit(None).cast("string").alias("county"),
        (user % 2 == 0).alias("is_active"), F.lit("2023-01-01").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_sent_at"), F.concat(F.lit("t"), user.cast("string")).alias("token"))
    home = F.when(i % 2 == 0, "Home").otherwise("Work")
    events = e.where("event_type in ('signup', 'error')").select(
        "ts", F.when(F.col("event_type") == "signup", "subscribe").otherwise("unsubscribe").alias("kind"), mail.alias("email"), home.alias("address"),
        (1 + i % 5).cast("double").alias("radius_km"), F.when(i % 4 == 0, "Dublin").alias("county"),
        F.when((user % 3 == 0) & (i % 2 == 0), F.concat(F.lit("t"), user.cast("string")))
        .otherwise(incremental.subscription_token(mail, home)).alias("token"))
    out = incremental.apply_subscription_events(base, events).drop("last_sent_at", "token")
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def query_log(spark, d):
    """The events as a search log; some rows arrive late."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), "ts", (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 4).cast("int"))).alias("arrived_at"),
        F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("endpoint"), F.col("event_type").alias("geocode_source"),
        F.get_json_object("props", "$.k").cast("int").alias("result_count"), F.col("value").alias("elapsed_ms"))


@query("query_log_stats", """
SELECT window_start, geocode_source, queries, empty, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, max_ms FROM (SELECT date_trunc('day', ts) AS window_start, event_type AS geocode_source, count(*) AS queries, count(*) FILTER (CAST(props->>'$.k' AS INT) = 0) AS empty, quantile_cont(value, 0.5) AS p50_ms,
  quantile_cont(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events WHERE user_id%4 <= 2 GROUP BY ALL)""")
def _(spark, d):
    r = incremental.query_log_stats(query_log(spark, d), "1 day", "2 hours")
    return r.withColumn("p50_ms", round_to("p50_ms", 6)).withColumn("p95_ms", round_to("p95_ms", 6))


@query("county_filter_audit", over_sales(
    """SELECT query_id, r.county AS asked_county, count(*) AS total, count(*) FILTER (lower(f.county) <> lower(r.county)) AS wrong, string_agg(DISTINCT f.county, ',' ORDER BY f.county) AS counties FROM found f JOIN requests r USING (query_id) WHERE r.county IS NOT NULL AND NOT county_dropped GROUP BY ALL""", *_RADIUS_CTES))
def _(spark, d):
    # equal requests have equal audits: made once, and given to each request last
    rows, members = search.shared_radius_search(*_radius_asks(spark, d), limit=25)
    audits = for_each_request(incremental.county_filter_audit(rows), members)
    return audits.withColumn("counties", F.array_join("counties", ","))


@query("request_budget", over_sales(
    f"""SELECT id, running_need, remaining FROM (SELECT id, CAST(sum(1 + id%3) OVER (ORDER BY price DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_need, 9000 - (SELECT CAST(sum(request_count) AS BIGINT) FROM ({API_USAGE_SQL}) WHERE ts >= TIMESTAMP '2024-01-10') AS remaining FROM dwelling)
       WHERE running_need <= remaining"""))
def _(spark, d):
    work = dwelling_sales(spark, d).withColumn("need", 1 + F.col("id") % 3)
    return (incremental.request_budget(work, api_usage(spark, d), [F.col("price").desc(), F.col("id")], "2024-01-10", limit=9_000)
            .select("id", "running_need", "remaining"))
