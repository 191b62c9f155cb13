"""Scalar rules on literal cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ratelens.functions import cancellation, labels, meals, offers, pricing, tax


def one(df, col):
    return df.select(F.col(col) if isinstance(col, str) else col.alias("x")).first()[0]


def text_frame(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_stay_and_price(make):
    d = make({"check_out": "2026-12-03", "total_price": 24000}, price=True).first()
    assert (d.nights, d.nightly_adr_twd, d.price_per_sqm) == (2, 12000.0, 240.0)


def test_foreign_total_uses_rate_and_missing_rate_is_unknown(make):
    rows = make({"currency": "USD", "total_price": 400, "fx_rate_to_twd": 30}, {"currency": "USD", "total_price": 400}, {"currency": "ntd", "total_price": 5000}, price=True)
    assert [r.nightly_adr_twd for r in rows.orderBy("observation_id").collect()] == [12000.0, None, 5000.0]


def test_stored_total_wins_and_zero_is_unknown(make):
    rows = make({"total_twd": 9000, "total_price": 1}, {"total_price": 0}, {"total_price": -5}, price=True)
    assert [r.nightly_adr_twd for r in rows.orderBy("observation_id").collect()] == [9000.0, None, None]


def test_nights_fall_back_to_the_stored_number(make):
    rows = make({"check_out": None, "nights": 3}, {"check_out": None}, {"check_out": "2026-11-30", "nights": 0}, price=True)
    assert [r.nights for r in rows.orderBy("observation_id").collect()] == [3, 1, None]


def test_unit_price_falls_back_only_when_size_is_unknown(make):
    rows = make({"room_size_sqm": None, "price_per_sqm": 300, "check_out": "2026-12-03"}, {"room_size_sqm": 0, "price_per_sqm": 300}, price=True)
    assert [r.price_per_sqm for r in rows.orderBy("observation_id").collect()] == [150.0, None]


def test_cpi(make):
    d = make({"total_price": 11550, "cpi_index": 110, "cpi_base_index": 100}, {"cpi_adjusted_twd": 8000, "check_out": "2026-12-03"}, price=True)
    assert [round(r.cpi_adjusted_nightly_twd, 6) for r in d.orderBy("observation_id").collect()] == [10500.0, 4000.0]


def test_size_bands_and_occupancy(make):
    rows = make(*[{"room_size_sqm": s} for s in (44.9, 45, 60, 80, 0, None)])
    got = [r[0] for r in rows.orderBy("observation_id").select(pricing.size_band()).collect()]
    assert got == ["<45㎡", "45–59㎡", "60–79㎡", "80㎡+", "unknown", "unknown"]
    odd = make({"rooms": 0}, {"adults": 0}, {"children": -1}, {"adults": "many"}, {})
    assert [r[0] for r in odd.orderBy("observation_id").select(pricing.occupancy_key()).collect()] == ["unknown"] * 4 + ["1r-2a-0c"]


def test_fx_reciprocal_and_bad_rate(spark):
    assert one(spark.createDataFrame([(0.04,)], "r double"), pricing.fx_to_twd("r")) == pytest.approx(25.0)
    with pytest.raises(Exception, match="invalid FX rate"):
        spark.createDataFrame([(0.0,)], "r double").select(pricing.fx_to_twd("r")).collect()


def test_tax_reconciliation(make):
    parts = {"tax_inclusion": "unknown", "price_before_tax": 10000, "service_charge": 1000, "tax": 500}
    rows = make(
        {**parts, "total_price": 11500}, {**parts, "total_price": 12000}, {**parts, "total_price": 11501}, {**parts, "total_price": 11501.2},
        {**parts, "tax_inclusion": "excluded", "total_price": 11500}, {"tax_inclusion": "unknown", "price_before_tax": 10000},
        {**parts, "tax": -500, "total_price": 10500}, {**parts, "total_price": 20000, "price_before_tax": 18498},
    )
    got = [r[0] for r in rows.orderBy("observation_id").select(tax.tax_inclusion()).collect()]
    # 11501.2 is within 0.01% of the total (1.15), but not of 1 alone; 20000 allows 2.
    assert got == ["included", "unknown", "included", "unknown", "excluded", "unknown", "unknown", "included"]


def test_tax_split_adds_up(spark):
    d = tax.split_inclusive_total(spark.createDataFrame([(11550.0,), (9999.0,)], "total_price double"))
    for r in d.collect():
        assert float(r.split_base + r.split_service + r.split_tax) == r.total_price
    assert float(d.first().split_base) == 10000.0


DEADLINES = [
    ("入住日前至少 3 天取消可免收取消費", "2027-01-09", "2027-01-06"),
    ("入住前至少14天取消可全額退款", "2026-12-20", "2026-12-06"),
    ("入住 3 天前取消可全額退款", "2026-12-20", "2026-12-17"),
    ("預定住宿日前第三日以前取消，退還預收約定房價總金額百分之百", "2026-12-20", "2026-12-17"),
    ("抵達前免費取消最多 15:00 1 天", "2026-12-20", "2026-12-19"),
    ("2026年12月17日前可全額退款", "2026-12-20", "2026-12-17"),
    ("12 月 15 日前可全額退款", "2026-12-20", "2026-12-15"),
    ("12 月 30 日前可全額退款", "2027-01-02", "2026-12-30"),
    ("15 Dec 2026 before arrival", "2026-12-20", "2026-12-15"),
    ("No charge when cancelled the day prior to arrival", "2026-12-20", "2026-12-19"),
    ("Reservations must be cancelled three day prior to arrival", "2026-12-22", "2026-12-19"),
    ("Reservations must be cancelled ten days prior to arrival", "2027-01-16", "2027-01-06"),
    ("Any change must be made by 3pm, five (5) days prior to arrival.", "2026-12-20", "2026-12-15"),
    ("before 2026-02-30", "2026-12-20", "unknown"),
    ("2 月 30 日前可全額退款", "2026-12-20", "unknown"),
    ("0 days prior to arrival", "2026-12-20", "unknown"),
    ("Free cancellation", "2026-12-20", "unrestricted"),
    ("Non-refundable", "2026-12-20", "non_refundable"),
    ("取消須付費", "2026-12-20", "unknown"),
    (None, "2026-12-20", "unknown"),
]


def test_deadlines(spark):
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(DEADLINES)], "i int, cancellation_policy string, check_in string, want string")
    assert [(r.cancellation_policy, r[1]) for r in d.orderBy("i").select("cancellation_policy", cancellation.cancellation_deadline()).collect()] == [(p, w) for p, _, w in DEADLINES]
    # The per-distinct-text form gives the same.
    got = cancellation.with_policy_terms(d).where("cancellation_deadline <> want")
    assert got.count() == 0


CLASSES = {
    "入住 3 天前取消可全額退款": "conditional", "Free cancellation before 2026-10-12": "conditional", "Free cancellation": "free_cancellation",
    "取消須付費（訂單總額）；無需訂金": "non_refundable", "不得退款": "non_refundable", "事先付款・無法退款": "non_refundable",
    "subject to 100% of stay room charge, plus taxes": "non_refundable", "取消須付費": "unknown", "將收取取消費用": "unknown", "": "unknown",
}


def test_classes(spark):
    d = text_frame(spark, list(CLASSES), "cancellation_policy")
    assert {r[0]: r[1] for r in d.select("cancellation_policy", cancellation.cancellation_class()).collect()} == CLASSES


def test_schedule(spark):
    tiers = "取消費用 13~4天之前 訂金的30％ 3~1天之前 訂金的70％ 當天 訂金的100％"
    d = text_frame(spark, [tiers, "1~3天之前 訂金的30％ 當天 訂金的100％", "當天 訂金的100％", "3~1天之前 訂金的170％ 當天 訂金的10％"], "cancellation_policy")
    got = [[tuple(t) for t in r[0]] for r in d.orderBy("i").select(cancellation.cancellation_schedule()).collect()]
    assert got == [[(13, 4, 30, "deposit"), (3, 1, 70, "deposit"), (0, 0, 100, "deposit")], [], [], []]
    assert d.where("i = 0").select(cancellation.cancellation_class()).first()[0] == "conditional"


@pytest.mark.parametrize("text,value", [("十", 10), ("三", 3), ("十五", 15), ("二十", 20), ("二十一", 21), ("二三", None)])
def test_cjk_numbers(spark, text, value):
    assert one(text_frame(spark, [text]), cancellation.cjk_integer("t")) == value


def test_blockers(spark):
    d = text_frame(spark, ["fee � here", "Cancellation policy is available on the official booking page", " 將收取取消費用 ", "ask us"], "cancellation_policy")
    got = [r[0] for r in d.orderBy("i").select(cancellation.cancellation_blocker()).collect()]
    assert got == ["encoding_corruption", "generic_placeholder", "generic_fee_notice", "unparsed_policy"]


MEALS = {
    "一般訂房｜含島語早餐": True, "一般訂房｜不含島語早餐": False, "提前7天訂房 - 不含餐食": False, "住宿券專案含2早送宵夜": True, "一般訂房": None,
    "Room  ONLY": False, "with breakfast": True, "餐點: 早餐": True, "純住宿": False,
}


def test_breakfast(spark):
    d = text_frame(spark, list(MEALS), "rate_plan_name").withColumn("breakfast_included", F.lit(None).cast("boolean"))
    assert {r.rate_plan_name: r.breakfast_included for r in meals.with_breakfast(d).collect()} == MEALS
    kept = d.where("rate_plan_name = '純住宿'").withColumn("breakfast_included", F.lit(True))
    assert meals.with_breakfast(kept).first().breakfast_included is True


def test_labels(spark):
    d = text_frame(spark, [" Deluxe Room – King ", "deluxe room-king", "ＤＥＬＵＸＥ①", "豪華 客房（一大床）", "Straße", None, "--"], "room_type_name")
    got = [r.norm_label for r in labels.with_normalized_label(d).orderBy("i").collect()]
    assert got == ["deluxeroomking", "deluxeroomking", "deluxe1", "豪華客房一大床", "strasse", "", ""]


def test_room_helpers(spark):
    rows = [("豪華套房", None), (None, "Pool Villa"), ("豪華雙床客房", None), (None, "King or Twin"), ("一大床", None), (None, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name_zh string, name_en string").withColumns(
        {"name_ja": F.lit(None).cast("string"), "aliases_zh": F.lit(None).cast("array<string>")}
    )
    got = [tuple(r) for r in d.orderBy("i").select(labels.room_class(), labels.bed_type()).collect()]
    # The queen token is part of a king token, so such a label counts as multiple.
    assert got == [("suite", "unspecified"), ("villa", "unspecified"), ("room", "twin"), ("room", "multiple"), ("room", "multiple"), ("room", "unspecified")]


def test_area_spec(spark):
    d = spark.createDataFrame([(0, 48.0, None, None), (1, None, 45.0, 59.0), (2, None, 45.5, None), (3, -1.0, None, None), (4, 30.0, None, 40.0)], "i int, size_sqm double, size_sqm_min double, size_sqm_max double")
    got = [tuple(r[0]) for r in d.orderBy("i").select(labels.area_spec()).collect()]
    assert got == [(48.0, 48.0, "48"), (45.0, 59.0, "45-59"), (45.5, 45.5, "45.5"), (None, None, None), (30.0, 40.0, "30-40")]


def test_offer_texts(spark):
    t = text_frame(spark, ["約 45.5 平方公尺", "10坪", "面積：38 m²", "nothing"])
    assert [None if r[0] is None else float(r[0]) for r in t.orderBy("i").select(offers.area_from_offer("t")).collect()] == [45.5, 33.06, None, None]
    assert float(one(t.where("i = 1"), offers.area_from_ping("t", 1))) == 33.1
    assert float(one(t.where("i = 2"), offers.area_from_text("t", "labelled"))) == 38.0
    u = spark.createDataFrame([(300.0, "sqft"), (30.0, "SQM"), (30.0, None), (-1.0, "sqm")], "v double, u string")
    assert [None if r[0] is None else float(r[0]) for r in u.select(offers.area_from_unit("v", "u")).collect()] == [27.87, 30.0, None, None]


def test_currency_from_text(spark):
    t = text_frame(spark, ["NTD 5,000", "NT$ 5,000", "US $ 120", "¥9,000", "$99", "120", "8,800", "JPY¥ 100"])
    money = offers.money_from_text("t")
    got = [r[0] for r in t.orderBy("i").select(offers.resolve_currency(F.col("t"), money)).collect()]
    assert got == ["TWD", "TWD", "USD", "JPY", "USD", "USD", "TWD", "JPY"]


def test_redaction(spark):
    t = text_frame(spark, ["HTTP 403  https://x.test/?token=secret&a=1", "Authorization: Bearer abc123", "x" * 600])
    got = [r[0] for r in t.orderBy("i").select(offers.safe_reason("t")).collect()]
    assert "secret" not in got[0] and "[redacted]" in got[0] and "&a=1" in got[0]
    assert "abc123" not in got[1] and len(got[2]) == 500
    assert one(t.where("i = 0"), offers.status_from_text("t")) == 403


def test_plan_filters(spark):
    t = text_frame(spark, ["Best Rate", "MEMBER rate", "Rack Rate", "Fans of M.O. offer"])
    assert [r[0] for r in t.orderBy("i").select(offers.public_plan("t")).collect()] == [True, False, False, False]


def test_mirror_rules_see_url_and_method(make):
    rows = make(
        {"hotel_id": "capella_taipei", "tax_inclusion": "unknown", "source_method": "public_booking_page"},
        {"hotel_id": "capella_taipei", "tax_inclusion": "", "source_method": "x", "source_url": "https://a/?Hotel=47696&b"},
        {"hotel_id": "grand_hotel_taipei", "tax_inclusion": None, "source_url": "https://a/webhotel-v5/1071?x"},
        {"hotel_id": "grand_hotel_taipei", "tax_inclusion": "unknown", "source_url": "https://a/other"},
        {"tax_inclusion": "excluded"},
    )
    assert [r[0] for r in rows.orderBy("observation_id").select(tax.mirror_tax_inclusion()).collect()] == ["included", "included", "included", "unknown", "excluded"]


def test_dates_are_dates(make):
    r = make({}).first()
    assert r.check_in == date(2026, 12, 1)


def test_full_width_digits(make):
    d = make({"cancellation_policy": "入住前至少 ３ 天取消", "check_in": "2026-12-10"})
    got = d.select(cancellation.cancellation_deadline().alias("x")).first().x
    assert got == "2026-12-07"


def test_rows_of_one_text_stay_spread(spark):
    """Also where Spark can't tell before it runs that the texts are few."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        policy, plan = F.when(F.col("id") % 9 > 0, F.lit("Free cancellation")), F.when(F.col("id") % 8 > 0, F.lit("Zimmer mit Fr\u00fchst\u00fcck"))
        d = spark.range(0, 8000, 1, 8).select("id", policy.alias("cancellation_policy"), plan.alias("rate_plan_name"), F.lit("2026-12-01").alias("check_in"), F.lit(None).cast("boolean").alias("breakfast_included"))
        for out in (cancellation.with_policy_terms(d), meals.with_breakfast(d), labels.with_normalized_label(d, "rate_plan_name")):
            # All columns are used, so that none of the joins is left out.
            tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max(F.hash("*"))).collect()
            assert sum(r.n for r in tasks) == 8000 and max(r.n for r in tasks) == 1000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
