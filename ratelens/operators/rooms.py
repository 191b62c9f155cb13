"""Room-type dimension: build, integrity, and matching of observations to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelens.functions.labels import (
    area_spec, bed_type, cjk_count, room_class, stable_room_id, with_normalized_label,
)
from ratelens.functions.pricing import positive
from ratelens.operators.containment import contained_labels
from ratelens.session import cut_lineage

ALIAS = (
    "struct<label:string,language:string,source_type:string,source_platform:string,room_type_code:string,"
    "source_url:string,observed_at:string,label_match:boolean>"
)
ROOM = (
    "struct<name_zh:string,name_en:string,name_ja:string,size_sqm:double,size_sqm_min:double,size_sqm_max:double,"
    f"room_count:int,aliases_zh:array<string>,aliases:array<{ALIAS}>>"
)
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _code_only(alias: Column) -> Column:
    return F.coalesce(alias["label_match"] == F.lit(False), F.lit(False))


def is_evidenced(alias: Column) -> Column:
    """A dated alias with an inspectable source; one that may only be matched by
    code also needs the source, the code and a plain ISO date."""
    dated = (_text(alias["label"]) != "") & _text(alias["source_url"]).startswith("https://") & (_text(alias["observed_at"]) != "")
    coded = (
        (_text(alias["source_platform"]) != "")
        & (_text(alias["room_type_code"]) != "")
        & _text(alias["observed_at"]).rlike(ISO_DATE)
    )
    return dated & (~_code_only(alias) | coded)


def evidenced_aliases(aliases: Column) -> Column:
    return F.filter(F.coalesce(aliases, F.array().cast(f"array<{ALIAS}>")), is_evidenced)


def explode_rooms(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("hotel_id") != "").select(
        "hotel_id",
        F.col("room_snapshot.source_type").alias("evidence_source_type"),
        F.col("room_snapshot.source_url").alias("evidence_source_url"),
        F.col("room_snapshot.observed_at").alias("evidence_observed_at"),
        F.explode("room_snapshot.rooms").alias("room"),
    )


def room_dimension(profiles: DataFrame) -> DataFrame:
    """One row per evidenced room, with class, area, family and stable id."""
    flat = explode_rooms(profiles).select("hotel_id", "room.*", *[f"evidence_{c}" for c in ("source_type", "source_url", "observed_at")])
    exact = positive("size_sqm")
    out = flat.withColumns({"_area": area_spec(), "room_class": room_class(), "bed_type": bed_type()})
    out = out.withColumns(
        {
            "size_sqm": exact,
            "size_sqm_min": F.col("_area.size_sqm_min"),
            "size_sqm_max": F.col("_area.size_sqm_max"),
            "area_spec_key": F.col("_area.area_spec_key"),
            "aliases_zh": F.coalesce("aliases_zh", F.array().cast("array<string>")),
            "aliases": evidenced_aliases(F.col("aliases")),
        }
    ).drop("_area")
    return out.withColumns(
        {
            "stable_room_type_id": stable_room_id(),
            "normalized_room_family": F.concat_ws(":", "room_class", F.coalesce("area_spec_key", F.lit("unknown"))),
            "normalization_method": F.lit("room_class_and_published_area"),
            "strict_parity_eligible": F.lit(False),
        }
    )


def ordered_rooms(dimension: DataFrame) -> DataFrame:
    """Listing order: hotel, area with unknown last, id."""
    return dimension.orderBy("hotel_id", F.col("size_sqm_min").asc_nulls_last(), "stable_room_type_id")


def hotel_room_summaries(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("hotel_id").agg(
        F.count("*").alias("room_name_count"),
        F.countDistinct("area_spec_key").alias("area_spec_count"),
        F.countDistinct("normalized_room_family").alias("normalized_family_count"),
    )


def label_index(dimension: DataFrame) -> DataFrame:
    """Distinct (hotel, normalised label, room) triples that text may match."""
    names = dimension.select(
        "hotel_id", "stable_room_type_id", "normalized_room_family", "room_class", "size_sqm_min", "size_sqm_max",
        F.explode(
            F.concat(
                F.array("name_zh", "name_en", "name_ja"),
                "aliases_zh",
                F.transform(F.filter("aliases", lambda a: ~_code_only(a)), lambda a: a["label"]),
            )
        ).alias("label"),
    ).where("label <> ''")
    return with_normalized_label(names, "label", "norm").drop("label").where("norm <> ''").distinct()


def code_index(dimension: DataFrame) -> DataFrame:
    """Distinct (hotel, source, code, room) that a source's own code may match."""
    a = dimension.select(
        "hotel_id", "stable_room_type_id", "normalized_room_family", "room_class", "size_sqm_min", "size_sqm_max",
        F.explode("aliases").alias("alias"),
    )
    return (
        a.withColumns({"source": _text(F.col("alias.source_platform")), "code": _text(F.col("alias.room_type_code"))})
        .where("source <> '' and code <> ''")
        .drop("alias")
        .distinct()
    )


_ROOM_COLUMNS = ["stable_room_type_id", "normalized_room_family", "room_class", "size_sqm_min", "size_sqm_max"]
SUBJECT = ["hotel_id", "source_platform", "room_type_code", "room_type_name", "room_size_sqm"]


def _contained_labels(subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """Rooms whose label is literally contained in the observed one, longest label
    first, ties kept. Labels and observed ones meet over a q-gram index: labels of a
    hotel are never paired with all its rooms, and the work follows their lengths."""
    specific = (F.length("norm") >= 5) | (F.col("area").isNotNull() & (cjk_count("norm") >= 4))
    held = contained_labels(subjects, labels, ["hotel_id"], "norm_label", "norm")
    hits = subjects.select("subject", "hotel_id", "norm_label", "area").join(held, ["hotel_id", "norm_label"]).where(specific).join(labels, ["hotel_id", "norm"])
    w = Window.partitionBy("subject").orderBy(F.length("norm").desc())
    return hits.withColumn("_rk", F.rank().over(w)).where("_rk = 1").select("subject", *_ROOM_COLUMNS)


def _subject():
    # JSON leaves nulls out by name, so a missing value differs from every text.
    return F.md5(F.to_json(F.struct(*SUBJECT)))


def match_rooms(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Resolve every observation to at most one evidenced room.

    Tiers, each used only if the one before has no candidate at all: the source's
    code, the exact normalised label, literal containment of a label. Then a known
    area must agree within 1 sqm, and exactly one candidate must remain.

    Matching runs once per distinct (hotel, source, code, name, size) and is joined
    back by a 128-bit digest of these, taken in the pass over the rows, so the cost follows the variety of labels and not the number of rows. The
    distinct subjects and both indexes are written once, because every tier reads
    them: the rows are scanned twice in all. The verdicts are written too, as the texts of
    ``per_distinct`` are: few are broadcast and the rows stay where they are."""
    labels = cut_lineage(label_index(dimension), "room-labels")
    codes = cut_lineage(code_index(dimension), "room-codes")
    subjects = with_normalized_label(df.select(*SUBJECT).distinct())
    subjects = subjects.withColumns(
        {
            "area": positive("room_size_sqm"),
            "subject": _subject(),
            "source": _text(F.col("source_platform")),
            "code": _text(F.col("room_type_code")),
        }
    )
    subjects = cut_lineage(subjects, "room-subjects")
    by_code = (
        subjects.where("source <> '' and code <> ''")
        .join(codes, ["hotel_id", "source", "code"])
        .select("subject", *_ROOM_COLUMNS)
        .withColumn("tier", F.lit(1))
    )
    by_label = (
        subjects.where("norm_label <> ''")
        .join(labels.withColumnRenamed("norm", "norm_label"), ["hotel_id", "norm_label"])
        .select("subject", *_ROOM_COLUMNS)
        .withColumn("tier", F.lit(2))
    )
    exact = by_code.unionByName(by_label)
    open_subjects = subjects.join(exact.select("subject").distinct(), "subject", "left_anti").where("norm_label <> ''")
    contained = _contained_labels(open_subjects, labels).withColumn("tier", F.lit(3))
    candidates = exact.unionByName(contained).distinct()
    first = Window.partitionBy("subject").orderBy("tier")
    used = candidates.withColumn("_t", F.rank().over(first)).where("_t = 1")
    with_area = used.join(subjects.select("subject", "area"), "subject").withColumn(
        "fits",
        F.col("area").isNull()
        | F.coalesce(F.col("area").between(F.col("size_sqm_min") - 1, F.col("size_sqm_max") + 1), F.lit(False)),
    )
    fit = F.col("fits")
    verdict = with_area.groupBy("subject").agg(
        F.min("tier").alias("tier"),
        F.count_if(fit).alias("n_fit"),
        *[F.max(F.when(fit, F.col(c))).alias(c) for c in ("stable_room_type_id", "normalized_room_family", "room_class")],
    )
    one = F.col("n_fit") == 1
    status = (
        F.when(F.col("n_fit").isNull(), F.when(F.col("norm_label") == "", F.lit("missing_room_type_name")).otherwise(F.lit("unmatched_label")))
        .when(F.col("n_fit") == 0, F.lit("area_mismatch"))
        .when(~one, F.lit("ambiguous_label"))
        .when(F.col("tier") == 1, F.lit("matched_evidenced_source_code"))
        .when(F.col("tier") == 2, F.lit("matched_exact_evidenced_label"))
        .otherwise(F.lit("matched_evidenced_label_with_descriptors"))
    )
    found = subjects.join(verdict, "subject", "left").select(
        F.col("subject").alias("_subject"),
        status.alias("room_match_status"),
        *[F.when(one, F.col(c)).alias(c) for c in ("stable_room_type_id", "normalized_room_family", "room_class")],
    )
    found = cut_lineage(found, "room-verdicts")
    clean = df.drop("room_match_status", "stable_room_type_id", "normalized_room_family", "room_class")
    return clean.withColumn("_subject", _subject()).join(found, "_subject", "left").drop("_subject")


def source_code_conflicts(dimension: DataFrame) -> DataFrame:
    """(hotel, source, code) that point to more than one room."""
    return (
        code_index(dimension)
        .groupBy("hotel_id", F.col("source").alias("source_platform"), F.col("code").alias("room_type_code"))
        .agg(F.array_sort(F.collect_set("stable_room_type_id")).alias("stable_room_type_ids"))
        .where(F.size("stable_room_type_ids") > 1)
    )


def label_conflicts(dimension: DataFrame) -> DataFrame:
    """Matchable alias labels that point to more than one room."""
    a = dimension.select("hotel_id", "stable_room_type_id", F.explode(F.filter("aliases", lambda x: ~_code_only(x))).alias("a")).select(
        "hotel_id", "stable_room_type_id", F.col("a.label").alias("label")
    )
    return (
        with_normalized_label(a, "label", "normalized_label")
        .where("normalized_label <> ''")
        .groupBy("hotel_id", "normalized_label")
        .agg(
            F.min("label").alias("example_label"),
            F.array_sort(F.collect_set("stable_room_type_id")).alias("stable_room_type_ids"),
        )
        .where(F.size("stable_room_type_ids") > 1)
    )


def incomplete_code_aliases(profiles: DataFrame) -> DataFrame:
    """Code-only aliases that lack what a code match needs."""
    a = explode_rooms(profiles).select("hotel_id", "room", F.explode("room.aliases").alias("a")).where(_code_only(F.col("a")))
    alias = F.col("a")
    checks = {
        "label": _text(alias["label"]) == "",
        "source_platform": _text(alias["source_platform"]) == "",
        "room_type_code": _text(alias["room_type_code"]) == "",
        "source_url": ~_text(alias["source_url"]).startswith("https://"),
        "observed_at": ~_text(alias["observed_at"]).rlike(ISO_DATE),
    }
    missing = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return a.select(
        "hotel_id",
        F.coalesce("room.name_en", "room.name_zh", "room.name_ja").alias("room_name"),
        F.col("a.label").alias("alias_label"),
        missing.alias("missing_fields"),
    ).where(F.size("missing_fields") > 0)


def evidence_quality(profiles: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """One row of problem counts."""
    dim = dimension if dimension is not None else room_dimension(profiles)
    kinds = {
        "source-code conflicts": source_code_conflicts(dim),
        "matchable-label conflicts": label_conflicts(dim),
        "incomplete code-only aliases": incomplete_code_aliases(profiles),
    }
    out = None
    for kind, df in kinds.items():
        part = df.agg(F.count("*").alias("problems")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "problems")


def assert_room_integrity(profiles: DataFrame) -> None:
    """Stop before publishing when the evidence contradicts itself. An action over
    three counts."""
    bad = [f"{r.problems} {r.kind}" for r in evidence_quality(profiles).collect() if r.problems]
    if bad:
        raise ValueError("Room-type evidence integrity gate failed: " + ", ".join(bad))
