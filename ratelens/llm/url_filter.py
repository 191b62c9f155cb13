"""URL filters by a sort-merge range join.

A rule is a host and a path prefix. Host labels are reversed, so that a host and its
subdomains share a prefix of labels, and each level of a page's host is looked at as a
canonical key (reversed host, path). In the order of these keys the urls that a rule
fits are an interval that begins with the rule's own key, and intervals nest or are
apart. Rules and keys are sorted together and swept: each key takes the stack of nested
rules that was active at the last rule before it, and the deepest one that has not ended
yet is the longest fit.

The sweep runs by reversed host. Urls are made distinct first, only hosts with rules take
part, and a host with many urls is swept in splits of about ``split_rows``, each with the
host's rules.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelens.session import cut_lineage

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule (rhost, path) with all rules of its host that hold it, longest first."""
    ends = F.sequence(F.lit(0), F.length("path"))
    parts = rules.select("rhost", "path", F.explode(ends).alias("n")).withColumn("outer", F.expr("substring(path, 1, n)"))
    outer = rules.select("rhost", F.col("path").alias("outer"), "rule", "verdict")
    held = parts.join(outer, ["rhost", "outer"]).groupBy("rhost", "path")
    stack = F.reverse(F.array_sort(F.collect_list(F.struct("n", F.col("outer").alias("prefix"), "rule", "verdict"))))
    return held.agg(stack.alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", split_rows: int = 100_000) -> DataFrame:
    """Judge every row of ``pages`` by its url: (row, host, path, rule, verdict), with
    ``row`` all its columns but the url. ``rules`` are rows (host, path, verdict). A rule
    fits its host and all subdomains where the path starts with the rule's; the longest
    rule (host and path together, then the longer host) wins; ``rule`` is its host and
    path, null where none fits, and then the verdict is ``default``.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; path: from there up to ``?``, ``#`` or the end. A null url, or one without
    ``://``, has both empty. Of rules with equal host and path, the greatest verdict
    counts; rules with a null are ignored. Repeated rows are judged alike; without rules
    all get the default.
    """
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    rules = cut_lineage(rules.select(_reversed(labels).alias("rhost"), "path", F.concat("host", "path").alias("rule"), "verdict", F.size(labels).alias("levels")), "rules")
    deepest = rules.agg(F.max("levels")).first()[0] or 1

    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != url_col)).alias("row"), host(F.col(f"`{url_col}`")).alias("host"), path(F.col(f"`{url_col}`")).alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("labels", F.reverse(F.split("host", r"\.")))
    levels = F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))
    keys = urls.select("host", "path", F.explode(F.transform(levels, lambda n: F.array_join(F.slice("labels", F.lit(1), n), "."))).alias("rhost"))
    keys = cut_lineage(keys.join(rules.select("rhost").distinct(), "rhost", "left_semi"), "url-keys")

    splits = cut_lineage(keys.groupBy("rhost").agg(F.ceil(F.count("*") / split_rows).cast("long").alias("splits")), "splits")
    keys = keys.join(splits, "rhost").select("rhost", F.pmod(F.xxhash64("host", "path"), "splits").alias("split"), "path", "host", F.lit(1).alias("kind"))
    starts = _stacks(rules).join(splits, "rhost").select("rhost", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), "path", "stack", F.lit(0).alias("kind"))
    sweep = Window.partitionBy("rhost", "split").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = keys.unionByName(starts, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fit = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["prefix"])), F.lit(0))
    found = swept.select("host", "path", fit.alias("fit")).where("fit is not null")
    length = F.struct(F.length("fit.rule"), -F.col("fit.n"))
    found = cut_lineage(found.groupBy("host", "path").agg(F.max_by("fit", length).alias("fit")), "fits")
    return rows.join(found, ["host", "path"], "left").select("row", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
