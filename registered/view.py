"""The ``rates`` view over the given tables, once for Spark and once as SQL.

The given tables hold no rate observations, so line items stand in for them: one
line item is one observation. Only four date expressions differ by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.functions.meals import with_breakfast
from ratelens.functions.pricing import priced, publishable
from ratelens.operators.dedup import deduplicate
from ratelens.schema import conform
from ratelens.operators.parity import with_terms
from ratelens.session import RATES_CONF, configure, cut_lineage

_VIEW = """
base AS (
  SELECT l.*, o.o_orderpriority, p.p_name, {days} AS day_ix
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
lead AS (
  SELECT *, CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 14
                 WHEN 3 THEN 30 WHEN 4 THEN 60 ELSE 90 END AS lead_days
  FROM base),
rates AS (
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS observation_id,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('run-', day_ix) END AS run_id,
       {qat} AS queried_at,
       {cin} AS check_in,
       {cout} AS check_out,
       lead_days,
       1 AS rooms, 2 AS adults, 0 AS children,
       concat('hotel_', l_suppkey % 31) AS hotel_id,
       concat('Hotel ', l_suppkey % 31) AS hotel_name,
       CASE WHEN l_suppkey % 31 < 20 THEN 'Taipei' ELSE 'Taichung' END AS city,
       concat('R', l_partkey % 4) AS room_type_code,
       p_name AS room_type_name,
       CASE WHEN l_partkey % 4 = 3 THEN NULL
            ELSE CAST(35 + 15 * (l_partkey % 4) AS DOUBLE) END AS room_size_sqm,
       o_orderpriority AS rate_plan_code,
       CASE l_partkey % 3 WHEN 0 THEN 'BAR with breakfast'
                          WHEN 1 THEN 'Room only' ELSE 'Member offer' END AS rate_plan_name,
       CASE l_suppkey % 4 WHEN 0 THEN 'Free cancellation' WHEN 1 THEN 'Non-refundable'
            WHEN 2 THEN '3 days prior to arrival' ELSE NULL END AS cancellation_policy,
       l_extendedprice AS total_price,
       CASE WHEN l_linenumber % 4 = 1 THEN l_extendedprice - 1500
            WHEN l_linenumber % 4 = 3 THEN l_extendedprice - 1750 ELSE NULL END AS price_before_tax,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(1000 AS DOUBLE) ELSE NULL END AS service_charge,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(500 AS DOUBLE) ELSE NULL END AS tax,
       CASE WHEN l_linenumber % 2 = 0 THEN 'included' ELSE 'unknown' END AS tax_inclusion,
       CASE WHEN l_suppkey % 10 = 9 THEN 'USD' ELSE 'TWD' END AS currency,
       CAST(CASE WHEN l_suppkey % 10 = 9 THEN 30 ELSE 1 END AS DOUBLE) AS fx_rate_to_twd,
       CASE l_returnflag WHEN 'A' THEN 'booking_com' WHEN 'R' THEN 'expedia_group'
            ELSE 'official' END AS source_platform,
       CASE WHEN l_quantity = 1 THEN 'demo' ELSE 'live' END AS status
FROM lead)
"""

_COUT_DAYS = "day_ix + lead_days + CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 1 END"

SPARK_VIEW = _VIEW.format(
    days="datediff(CAST(o.o_orderdate AS DATE), DATE '1995-01-01') % 30",
    qat="CAST(date_add(DATE '2026-09-01', CAST(day_ix AS INT)) AS TIMESTAMP) + make_dt_interval(0, l_linenumber)",
    cin="date_add(DATE '2026-09-01', CAST(day_ix + lead_days AS INT))",
    cout=f"date_add(DATE '2026-09-01', CAST({_COUT_DAYS} AS INT))",
)

SQL_VIEW = _VIEW.format(
    days="date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) % 30",
    qat="CAST(DATE '2026-09-01' + CAST(day_ix AS INTEGER) AS TIMESTAMP) + to_hours(l_linenumber)",
    cin="DATE '2026-09-01' + CAST(day_ix + lead_days AS INTEGER)",
    cout=f"DATE '2026-09-01' + CAST({_COUT_DAYS} AS INTEGER)",
)

# What the library derives, spelled out in SQL: nights, prices and their gates.
SQL_PRICED = """
priced0 AS (
  SELECT *, CAST(CASE WHEN check_out - check_in > 0 THEN check_out - check_in ELSE 1 END AS INTEGER) AS nights,
         CASE WHEN currency = 'TWD' THEN total_price ELSE total_price * fx_rate_to_twd END AS total_twd
  FROM rates),
priced AS (
  SELECT *, CASE WHEN total_twd > 0 THEN total_twd / nights END AS nightly,
         CASE WHEN room_size_sqm > 0 AND total_twd > 0 THEN total_twd / nights / room_size_sqm END AS unit,
         CAST(queried_at AS DATE) AS day,
         source_platform = 'official' AS is_official,
         room_size_sqm >= 45 AND room_size_sqm < 60 AS is_core
  FROM priced0),
official AS (SELECT * FROM priced WHERE is_official)
"""

SQL_DEDUP = """
ranked AS (
  SELECT *, row_number() OVER (
      PARTITION BY hotel_id, source_platform, check_in, check_out, rooms, adults, children,
                   room_type_code, rate_plan_code, currency, day
      ORDER BY queried_at DESC, observation_id DESC, total_price DESC) AS rn
  FROM priced WHERE status = 'live' AND nightly BETWEEN 3000 AND 2000000),
published AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)
"""

SQL_TERMS = """
terms0 AS (
  SELECT *,
    CASE WHEN lower(rate_plan_name) LIKE '%room only%' THEN false
         WHEN lower(rate_plan_name) LIKE '%with breakfast%' THEN true END AS breakfast_included,
    CASE WHEN rooms > 0 AND adults > 0 AND children >= 0
         THEN concat(rooms, 'r-', adults, 'a-', children, 'c') ELSE 'unknown' END AS occupancy,
    CASE WHEN room_size_sqm IS NULL OR room_size_sqm <= 0 THEN 'unknown' WHEN room_size_sqm < 45 THEN '<45㎡'
         WHEN room_size_sqm < 60 THEN '45–59㎡' WHEN room_size_sqm < 80 THEN '60–79㎡' ELSE '80㎡+' END AS size_band,
    CASE WHEN cancellation_policy IS NULL OR cancellation_policy = '' THEN 'unknown'
         WHEN lower(cancellation_policy) LIKE '%non-refundable%' THEN 'non_refundable'
         WHEN regexp_matches(lower(cancellation_policy), '[0-9]+.{0,30}(before|prior to)') THEN 'conditional'
         WHEN lower(cancellation_policy) LIKE '%free cancellation%' THEN 'free_cancellation'
         ELSE 'unknown' END AS cancellation_class,
    CASE WHEN tax_inclusion IN ('included', 'excluded') THEN tax_inclusion
         WHEN price_before_tax IS NOT NULL AND (service_charge IS NOT NULL OR tax IS NOT NULL)
              AND least(total_price, price_before_tax, coalesce(service_charge, 0), coalesce(tax, 0)) >= 0
              AND abs(CAST(total_price AS DECIMAL(18,4)) - (CAST(price_before_tax AS DECIMAL(18,4))
                  + CAST(coalesce(service_charge, 0) AS DECIMAL(18,4)) + CAST(coalesce(tax, 0) AS DECIMAL(18,4))))
                  <= greatest(CAST(1 AS DECIMAL(18,8)), CAST(abs(total_price) * 0.0001 AS DECIMAL(18,8)))
         THEN 'included' ELSE 'unknown' END AS tax_state
  FROM {source}),
terms AS (
  SELECT *,
    CASE cancellation_class WHEN 'non_refundable' THEN 'non_refundable' WHEN 'free_cancellation' THEN 'unrestricted'
         WHEN 'conditional' THEN CASE WHEN regexp_matches(lower(cancellation_policy), '[0-9]+ days? prior to arrival')
              THEN strftime(check_in - CAST(regexp_extract(lower(cancellation_policy), '([0-9]+) days? prior to arrival', 1) AS INTEGER), '%Y-%m-%d')
              ELSE 'unknown' END
         ELSE 'unknown' END AS cancellation_deadline
  FROM terms0)
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in (SQL_VIEW, *ctes)) + "\n" + body.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark, RATES_CONF)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as it is, before it is conformed to the rate schema."""
    for name in ("lineitem", "orders", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql("WITH " + SPARK_VIEW + " SELECT * FROM rates")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(raw_rates(spark, sf_dir))


def priced_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(rates(spark, sf_dir))


def labelled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced rates with the breakfast flag read from the plan label."""
    return with_breakfast(priced_rates(spark, sf_dir))


_written: dict[tuple[str, str], DataFrame] = {}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columnar mirror of the view, with prices and terms derived once.

    Analytics read this table rather than the raw rows, as the warehouse does. It is
    written once per application to the shared folder, so that scans prune columns
    and push filters down; the build itself is the query ``SNK2_mirror_build``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        name = "mirror-" + sf_dir.strip("/").replace("/", "_")
        _written[key] = cut_lineage(mirror_rows(spark, sf_dir), name)
    return _written[key]


def mirror_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_terms(labelled_rates(spark, sf_dir))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishable rows, latest per natural key: what the analytics describe."""
    key = (spark.sparkContext.applicationId, sf_dir + "#published")
    if key not in _written:
        d = deduplicate(observations(spark, sf_dir).where(publishable()))
        _written[key] = cut_lineage(d, "published-" + sf_dir.strip("/").replace("/", "_"))
    return _written[key]
