"""Observation history as batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ratelens.functions.pricing import source_of
from ratelens.operators.digests import merkle
from ratelens.schema import DEFAULT_METHOD, LEGACY_DEFAULTS, RATE_SCHEMA, conform

# Every field is read as text and cast afterwards: producers write numbers both as
# JSON numbers and as strings, and a bad value must not spoil the row.
RAW_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in RATE_SCHEMA.fields])
CORRUPT = "_malformed"

# Monthly shards, month folders with daily shards, and the day folders that
# ``append_observations`` writes.
SHARD_PATH = r"/(.{4}-.{2}(\.jsonl|/.{4}-.{2}-.{2}\.jsonl)|month=.{4}-.{2}/day=.{4}-.{2}-.{2}/[^/]+\.json(\.gz)?)$"


def shard_filter() -> Column:
    return F.col("_metadata.file_path").rlike(SHARD_PATH)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    if path.endswith(".jsonl"):
        return reader.json(path)
    # The predicate is on file metadata, so other files are pruned, not read.
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path).where(shard_filter())


def _malformed() -> Column:
    # Spark refuses to read the text of bad lines alone, so another column is named;
    # no field of a line equals the whole line.
    text = F.col(CORRUPT)
    return text.isNotNull() & ~F.coalesce(text == F.col("observation_id"), F.lit(False))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """File and text of every line that is not valid JSON."""
    return _raw(spark, path).where(_malformed()).select(F.col("_metadata.file_path").alias("shard"), F.col(CORRUPT).alias("line"))


def read_observations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """History under ``path`` with the fixed schema. A malformed line fails the job
    that meets it, naming shard and text; otherwise such lines are left out."""
    raw = _raw(spark, path)
    return conform((_strict(raw) if strict else raw.where(~_malformed())).drop(CORRUPT))


def read_months(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """``read_observations`` of the shards of some months (yyyy-MM); no other is opened."""
    raw = _raw(spark, path).where(F.regexp_extract(F.substring_index("_metadata.file_path", path.rstrip("/") + "/", -1), r"(\d{4}-\d{2})", 1).isin(months))
    return conform(_strict(raw).drop(CORRUPT))


def _shard(path: str, of: Column) -> Column:
    """The day (yyyy-MM-dd) of a shard under ``path``, or the month (yyyy-MM) of a monthly one."""
    name = F.substring_index(of, path.rstrip("/") + "/", -1)
    day = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", day).otherwise(F.regexp_extract(name, r"(\d{4}-\d{2})", 1))


def source_portions(spark: SparkSession, path: str, months: list[str], most: int) -> list[list[str]]:
    """The shards of some months in runs of up to ``most`` bytes, or one day if that has
    more (a month, if its shard is monthly), in order of time. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(path)
    shards = files.where(F.col("path").rlike(SHARD_PATH)).groupBy(_shard(path, F.col("path")).alias("shard")).agg(F.sum("length").alias("bytes"))
    out, size = [], 0
    for r in shards.where(F.substring("shard", 1, 7).isin(months)).orderBy("shard").collect():  # one row a day
        if not out or size + r.bytes > most:
            out, size = [*out, []], 0
        out[-1].append(r.shard)
        size += r.bytes
    return out


def read_shards(spark: SparkSession, path: str, shards: list[str]) -> DataFrame:
    """``read_observations`` of the shards of some days, or months; no other is opened."""
    raw = _raw(spark, path).where(_shard(path, F.col("_metadata.file_path")).isin(shards))
    return conform(_strict(raw).drop(CORRUPT))


def source_ledger(spark: SparkSession, source_path: str) -> DataFrame:
    """Per month (month, files, bytes, digest) of a history: which files it has, by path,
    size and time of change. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(source_path)
    name = F.substring_index("path", source_path.rstrip("/") + "/", -1)
    leaf = F.sha2(F.concat_ws("|", name, F.col("length"), F.unix_millis("modificationTime")), 256)
    found = files.where(F.col("path").rlike(SHARD_PATH)).select(F.regexp_extract(name, r"(\d{4}-\d{2})", 1).alias("month"), "length", leaf.alias("leaf"))
    totals = found.groupBy("month").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return totals.join(merkle(found, ["month"], "leaf"), "month")


def _strict(raw: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Invalid JSON in "), F.col("_metadata.file_path"), F.lit(": "), F.col(CORRUPT))
    return raw.where(F.when(_malformed(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def stream_observations(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New JSON files as they arrive, whatever their names; files of other kinds are
    skipped. A malformed line fails the stream, naming file and text."""
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return conform(_strict(reader.json(path)).drop(CORRUPT))


def month_of(c="queried_at") -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")


def union_sources(history: DataFrame, *extra: DataFrame, months_of_history: bool = False) -> DataFrame:
    """History plus extra feeds, whatever columns each has. With
    ``months_of_history`` the feeds are limited to months the history covers."""
    out = history
    for e in extra:
        if months_of_history:
            months = history.select(month_of().alias("_m")).distinct()
            e = e.withColumn("_m", month_of()).join(months, "_m", "left_semi").drop("_m")
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def union_month(history: DataFrame, *extra: DataFrame, month: str) -> DataFrame:
    """The rows of one month from all sources."""
    return union_sources(history, *extra).where(month_of() == month)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Legacy sheet export (CSV with header): only model fields are kept, blanks are
    nulls, and blank columns that have a default take it."""
    raw = spark.read.option("header", "true").csv(path)
    known = [f.name for f in RATE_SCHEMA.fields if f.name in raw.columns]
    return apply_sheet_defaults(raw.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in known]))


def apply_sheet_defaults(df: DataFrame) -> DataFrame:
    d = conform(df)
    for name, default in {**LEGACY_DEFAULTS, "source_method": DEFAULT_METHOD}.items():
        d = d.withColumn(name, F.coalesce(F.col(name), F.lit(default).cast(d.schema[name].dataType)))
    return d


def sheet_rows(df: DataFrame) -> DataFrame:
    """All columns as text, null as the empty cell."""
    return df.select(*[F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields])


def with_source(df: DataFrame) -> DataFrame:
    """Backfill source and method of rows that predate the columns."""
    return df.withColumns(
        {
            "source_platform": source_of(),
            "source_method": F.coalesce(F.when(F.col("source_method") != "", F.col("source_method")), F.lit(DEFAULT_METHOD)),
        }
    )
