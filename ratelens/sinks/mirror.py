"""The columnar mirror: versioned write, verification, manifest, publication.

A version is written once and verified where it lies. The rows are fingerprinted before
anything is derived, in the pass that finds their distinct labels; the fingerprint of what was written comes
from the scan that counts its keys. Only if the two differ are keys compared one by one.
Publishing adds a manifest, which counts from the moment its ``_SUCCESS`` is there.
Nothing is copied and readers never see half a version.

A manifest names for each month the version that holds it, and the digest of the source
files that it was made from. ``update_mirror`` reads only the months whose digest changed.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from ratelens.functions.meals import with_breakfast
from ratelens.functions.pricing import mirror_nightly_adr_twd, stay_nights
from ratelens.functions.tax import mirror_tax_inclusion
from ratelens.operators.dedup import KEY_COLUMNS, with_natural_key
from ratelens.operators.digests import merkle
from ratelens.session import shuffles_removed
from ratelens.sinks import versions
from ratelens.sources.observations import month_of, read_shards, source_ledger, source_portions


def mirror_columns(df: DataFrame) -> DataFrame:
    """The mirror's own derivations: stored nights and prices win, tax by rule or
    reconciliation, breakfast from the label."""
    d = df.withColumns(
        {"_n": stay_nights(prefer="stored"), "_adr": mirror_nightly_adr_twd(), "_tax": mirror_tax_inclusion()}
    )
    d = d.withColumns({"nights": F.col("_n"), "nightly_adr_twd": F.col("_adr"), "tax_inclusion": F.col("_tax")}).drop("_n", "_adr", "_tax")
    return with_breakfast(d)


def with_month(df: DataFrame) -> DataFrame:
    """Rows without a time are a month of their own, so that none is lost."""
    return df.withColumn("month", F.coalesce(month_of(), F.lit("undated")))


# Fixed value: rows in a row group.
ROW_GROUP = 10_000
#: Rows in a file, so that the digest of a file never needs more than some hundred MB.
FILE_ROWS = 2_000_000
#: Bytes of source files, for each core, that an update writes at once.
SOURCE_BYTES = 128 << 20


def write_version(df: DataFrame, root: str, version: str | None = None, row_group: int = ROW_GROUP, file_rows: int = FILE_ROWS, mode: str = "errorifexists") -> str:
    """Write one ZSTD Parquet version partitioned by month, every file ordered by
    ``queried_at, observation_id``. The shuffle files go with the write. Rebalancing groups by day without a sampling pass
    over the source, splits a large day over tasks and merges small ones."""
    path = f"{root}/versions/version={version or uuid.uuid4().hex}"
    order = ["month", "queried_at", "observation_id"]
    d = with_month(df).withColumn("_day", F.to_date("queried_at")).hint("rebalance", "month", "_day").drop("_day")
    w = d.sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd")
    w = w.option("parquet.block.row.count.limit", row_group).option("maxRecordsPerFile", file_rows)
    with shuffles_removed(df.sparkSession):
        w.partitionBy("month").parquet(path)
    return path


def key_digest(df: DataFrame) -> DataFrame:
    """``df`` with the natural key as 128 bits, in two longs."""
    return with_natural_key(df).withColumns({"key_hi": F.xxhash64(*KEY_COLUMNS), "key_lo": F.xxhash64(F.lit("low"), *KEY_COLUMNS)}).drop(*KEY_COLUMNS)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _total(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")


def _print() -> list[Column]:
    """Rows and the sums of both halves of their key digests: equal for the same rows in
    any order, and additive."""
    return [F.count("*").alias("rows"), F.coalesce(_total("key_hi"), F.lit("0")).alias("key_hi"), F.coalesce(_total("key_lo"), F.lit("0")).alias("key_lo")]


def fingerprints(df: DataFrame) -> DataFrame:
    """Per month: rows and the fingerprint of their natural keys."""
    return with_month(key_digest(df)).groupBy("month").agg(*_print())


def compare(source: DataFrame, target: DataFrame, months: list[str] | None = None) -> DataFrame:
    """Per month: rows on both sides and natural keys that only one side has, keys being
    compared by 128 bits. One shuffle; copies of a key are counted before it."""

    def side(df: DataFrame, s: int, t: int) -> DataFrame:
        d = with_month(key_digest(df)).select("month", "key_hi", "key_lo", F.lit(s).alias("s"), F.lit(t).alias("t"))
        return d if months is None else d.where(F.col("month").isin(months))

    per_key = side(source, 1, 0).unionByName(side(target, 0, 1)).groupBy("month", "key_hi", "key_lo").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return per_key.groupBy("month").agg(
        F.sum("s").alias("source_rows"),
        F.sum("t").alias("target_rows"),
        F.count_if(F.col("t") == 0).alias("missing_keys"),
        F.count_if(F.col("s") == 0).alias("extra_keys"),
    )


def differing_months(source: DataFrame, target: DataFrame) -> DataFrame:
    """Months (month) whose rows or natural keys differ, by their fingerprints."""
    names = ["rows", "key_hi", "key_lo"]
    both = fingerprints(source).join(fingerprints(target).toDF("month", *[f"t_{c}" for c in names]), "month", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return both.where(~same).select("month")


def comparison(source: DataFrame, target: DataFrame) -> DataFrame:
    """``compare`` for the months whose fingerprints differ; no rows if none does."""
    months = [r.month for r in differing_months(source, target).collect()]  # one value a month
    return compare(source, target, months)


def verify(source: DataFrame, target: DataFrame) -> None:
    """Abort unless every month has the same row count and the same key set."""
    bad = comparison(source, target).orderBy("month").take(5)
    if bad:
        raise ValueError(f"Mirror verification failed: {bad}")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Per file of a version (month, codec, rows, row groups, largest group, rows that
    aren't before their predecessor), read from the file itself in the tasks."""

    def job(batches):
        import io

        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for month, content in zip(batch.column("month").to_pylist(), batch.column("content"), strict=True):
                f = pq.ParquetFile(io.BytesIO(content.as_buffer()))
                groups = [f.metadata.row_group(i) for i in range(f.num_row_groups)]
                codecs = {g.column(c).compression for g in groups for c in range(g.num_columns)}
                at, name = (f.read([c]).column(0).combine_chunks() for c in ("queried_at", "observation_id"))
                n = len(at)
                a, b = at.slice(0, max(0, n - 1)), at.slice(min(1, n))
                later = pc.or_(pc.less(a, b), pc.and_(pc.equal(a, b), pc.less_equal(name.slice(0, max(0, n - 1)), name.slice(min(1, n)))))
                out.append((month, ",".join(sorted(codecs)), n, len(groups), max((g.num_rows for g in groups), default=0), (pc.sum(later).as_py() or 0) + min(1, n)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["month", "codec", "rows", "groups", "largest_group", "in_order"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.regexp_extract("path", r"month=([^/]+)/", 1).alias("month"), "content")
    return files.mapInArrow(job, "month string, codec string, rows long, groups long, largest_group long, in_order long")


def content_digest(df: DataFrame) -> DataFrame:
    """(month, digest) of the distinct natural keys: the same for the same keys, however
    they are written, ordered or repeated."""
    key = F.concat_ws("|", *KEY_COLUMNS)
    keys = with_month(with_natural_key(df)).select("month", F.sha2(key, 256).alias("leaf")).distinct()
    return merkle(keys, ["month"], "leaf")


def manifest(spark: SparkSession, version_path: str, source_digests: DataFrame | None = None) -> DataFrame:
    """Per month of a version: rows, natural keys, their fingerprint, files, bytes and
    the digest over the digests of its files."""
    rows = spark.read.parquet(version_path)
    per_key = key_digest(rows.withColumn("month", F.col("month").cast("string"))).groupBy("month", "key_hi", "key_lo").agg(F.count("*").alias("n"))
    whole = [F.sum(F.col(c).cast("decimal(20,0)") * F.col("n")).cast("decimal(38,0)").cast("string").alias(c) for c in ("key_hi", "key_lo")]
    counts = per_key.groupBy("month").agg(F.sum("n").alias("rows"), F.count("*").alias("natural_keys"), *whole)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(version_path)
    files = files.select(F.regexp_extract("path", r"month=([^/]+)/", 1).alias("month"), "length", F.sha2("content", 256).alias("sha"))
    sizes = files.groupBy("month").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    digests = merkle(files, ["month"], "sha").withColumnRenamed("digest", "sha256")
    out = counts.join(sizes, "month").join(digests, "month").withColumn("version", F.lit(version_path.rstrip("/").rsplit("/", 1)[-1].removeprefix("version=")))
    if source_digests is None:
        return out.withColumn("source_digest", F.lit(None).cast("string"))
    return out.join(source_digests.select("month", F.col("digest").alias("source_digest")), "month", "left")


def manifest_totals(m: DataFrame) -> DataFrame:
    """Natural keys carry the day, so months never share one and their counts add up."""
    return m.agg(F.sum("rows").alias("rows"), F.sum("natural_keys").alias("natural_keys"), F.count("*").alias("partitions"))


MANIFEST = (
    "month string, rows long, natural_keys long, key_hi string, key_lo string, bytes long, files long, sha256 string, version string, source_digest string"
)


def publish(spark: SparkSession, root: str, m: DataFrame) -> str:
    """Make ``m`` the current manifest; a reader sees the old one or all of the new one."""
    return versions.commit(spark, root, m.select(*[c.split()[0] for c in MANIFEST.split(", ")]))


def current_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    return versions.current(spark, root, MANIFEST)


def current_version(spark: SparkSession, root: str) -> Row:
    """Rows, bytes and the folders of the current months."""
    months = current_manifest(spark, root).collect()  # one row a month
    paths = [f"{root}/versions/version={m.version}/month={m.month}" for m in months]
    return Row(paths=paths, rows=sum(m.rows for m in months), bytes=sum(m.bytes for m in months))


def read_mirror(spark: SparkSession, root: str) -> DataFrame:
    """The current months. A mirror that holds none has no columns to show and fails."""
    paths = current_version(spark, root).paths
    if not paths:
        raise ValueError(f"The mirror at {root} holds no month")
    d = spark.read.option("basePath", f"{root}/versions").option("mergeSchema", "true").parquet(*paths)
    return d.withColumn("month", F.col("month").cast("string")).drop("version")


def _written(sources: list[DataFrame], root: str, digests: DataFrame | None = None, kept: DataFrame | None = None) -> str:
    """Write ``sources``, one after another, as one version, verify, and publish it beside
    the months ``kept``."""
    spark, version, seen = sources[0].sparkSession, uuid.uuid4().hex, []
    for source in sources:
        seen.append(Observation("mirror-" + uuid.uuid4().hex))
        watched = key_digest(source).observe(seen[-1], *_print()).drop("key_hi", "key_lo")
        path = write_version(mirror_columns(watched), root, version, mode="append")
    if versions.holds_files(spark, f"{path}/month=*"):
        with shuffles_removed(spark):
            made = manifest(spark, path, digests).collect()  # one row a month
        # Spark reports no metrics of an empty table
        found = [o.get for o, source in zip(seen, sources, strict=True) if len(sources) == 1 or not source.isEmpty()]
        if any(sum(int(m[c]) for m in made) != sum(int(f[c]) for f in found) for c in ("rows", "key_hi", "key_lo")):
            bad = comparison(_all(sources), spark.read.parquet(path)).orderBy("month").take(5)
            raise ValueError(f"Mirror verification failed: {bad or found}")
    elif all(source.isEmpty() for source in sources):
        made = []
    else:
        raise ValueError("Mirror verification failed: nothing was written")
    m = spark.createDataFrame([tuple(r[c.split()[0]] for c in MANIFEST.split(", ")) for r in made], MANIFEST)
    publish(spark, root, m if kept is None else m.unionByName(kept))
    return path


def build_mirror(source: DataFrame, root: str) -> str:
    """Write, verify against the source, then publish. The source is read twice, for its
    distinct labels and for its rows."""
    return _written([source], root)


def months_to_do(ledger: DataFrame, current: DataFrame | None) -> DataFrame:
    """(month, action): ``rebuild`` where the source files are new or changed, ``keep``
    where they are those of the manifest, ``drop`` where the source has none left."""
    if current is None:
        return ledger.select("month", F.lit("rebuild").alias("action"))
    both = ledger.select("month", "digest").join(current.select("month", "source_digest"), "month", "full")
    action = F.when(F.col("digest").isNull(), "drop").when(F.col("digest") == F.col("source_digest"), "keep").otherwise("rebuild")
    return both.select("month", action.alias("action"))


def update_mirror(spark: SparkSession, source_path: str, root: str) -> dict[str, str]:
    """Bring the mirror of a JSON history up to date and return what was done to each
    month. Files of months that did not change are not opened, and their part of the
    mirror stays where it is. They are written
    in portions of days, so that shuffle files don't grow with the history."""
    ledger, current = source_ledger(spark, source_path).collect(), current_manifest(spark, root)  # one row a month
    ledger = spark.createDataFrame(ledger, "month string, files long, bytes long, digest string")
    todo = {r.month: r.action for r in months_to_do(ledger, current).collect()}
    changed = sorted(m for m, action in todo.items() if action == "rebuild")
    kept = None if current is None else current.where(F.col("month").isin([m for m, action in todo.items() if action == "keep"]))
    if changed:
        portions = source_portions(spark, source_path, changed, SOURCE_BYTES * spark.sparkContext.defaultParallelism)
        _written([read_shards(spark, source_path, shards) for shards in portions], root, ledger, kept)
    elif "drop" in todo.values():
        publish(spark, root, kept)
    return todo
