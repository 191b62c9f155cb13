"""Which texts contain which labels, by an index of q-grams.

A label is filed once, under the one of its q-grams that the fewest texts of its scope
have; a text probes with its own distinct q-grams. So rows grow with the lengths of texts
and labels only, not with the number of labels or of their lengths, and a gram that is
common among the texts brings labels to them only where the label has no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Q = 3


def _grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters of a text that has as many."""
    starts = F.sequence(F.lit(1), F.length(text) - q + 1)
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(q)))))


def contained_labels(texts: DataFrame, labels: DataFrame, scope: list[str], text: str, label: str) -> DataFrame:
    """Rows (scope, text, label) for every distinct text and every distinct label of the
    same scope that it contains literally. Null or empty texts and labels take no part,
    nor do rows with a null scope. Labels of fewer than ``Q`` characters are their own
    gram."""
    texts = texts.select(*scope, F.col(text).alias("_text")).where("_text <> ''").distinct()
    labels = labels.select(*scope, F.col(label).alias("_label")).where("_label <> ''").distinct()
    every = F.flatten(F.filter(F.array(*[_grams(F.col("_text"), q) for q in range(1, Q + 1)]), lambda g: g.isNotNull()))
    probes = texts.select(*scope, "_text", F.explode(every).alias("_gram"))
    own = F.when(F.length("_label") < Q, F.array("_label")).otherwise(_grams(F.col("_label"), Q))
    offered = labels.select(*scope, "_label", F.explode(own).alias("_gram"))
    asked = probes.groupBy(*scope, "_gram").agg(F.count("*").alias("_asked"))
    # A gram that no text has can bring no hit, so such a label is not filed at all.
    rarest = offered.join(asked, [*scope, "_gram"], "left").groupBy(*scope, "_label").agg(F.min(F.struct(F.coalesce("_asked", F.lit(0)).alias("n"), "_gram")).alias("_by"))
    filed = rarest.where("_by.n > 0").select(*scope, "_label", F.col("_by._gram").alias("_gram"))
    hits = probes.join(filed, [*scope, "_gram"]).where(F.contains("_text", "_label"))
    return hits.select(*scope, F.col("_text").alias(text), F.col("_label").alias(label))
