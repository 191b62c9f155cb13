"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal), scored as sparse dot products.

Words are runs of letters, digits and bytes above 127; runs of other visible characters
count as words of their own. Case is kept. Words and pairs of neighbours are hashed to
``SIZE`` weights; all pairs of a word with itself are one n-gram. A text's features are their counts over the root of their number, and
a constant.

The fit takes at most ``max_rows`` labelled rows, those whose ids have the smallest
hashes, so it costs the same however large the corpus is. They are dealt by hash to
``SHARDS`` learners, which see their rows in hash order; the model is the mean of the
learners' weights, ``SIZE`` doubles at most. Scoring is one pass over all whole texts
without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType

from ratelens.llm.tables import keyed, result_schema
from ratelens.llm.textblocks import BYTE_A, U64, blocks, mix, pieces, prefix_hash, span_hash, text_buffer

BITS = 18
SIZE = 1 << BITS
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.01

_SAME = U64(0x5DEECE66D5DEECE6)

_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[:33] = 0


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight numbers (from 1; 0 is the constant) of all words and pairs of some rows,
    words before pairs in each piece of a long row, and the row of each."""
    found, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in pieces(data, offsets):
        part, kind = data[lo:hi], _KIND[data[lo:hi]]
        edge = np.zeros(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        edge[offsets[(offsets > lo) & (offsets < hi)] - lo] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(edge)
        full = kind[at[:-1]] > 0
        starts, ends = at[:-1][full], at[1:][full]
        w = mix(span_hash(prefix_hash(BYTE_A[part]), starts, ends))
        row = np.searchsorted(offsets, starts + lo, side="right") - 1
        pair = np.where(w[:-1] == w[1:], _SAME, mix(w[:-1] * U64(3) + w[1:]))[row[:-1] == row[1:]]
        for h, r in ((w, row), (pair, row[:-1][row[:-1] == row[1:]])):
            found.append((h >> U64(64 - BITS)).astype(np.int64) % (SIZE - 1) + 1)
            rows.append(r)
    return np.concatenate(found), np.concatenate(rows)


def _features(batches):
    """The distinct features of whole texts with their values."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        numbers, values = [], []
        for i, j in blocks(offsets):
            g, r = grams(data, offsets[i : j + 1])
            order = np.argsort(r, kind="stable")
            g, bounds = g[order], np.searchsorted(r[order], np.arange(j - i + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                number, count = np.unique(g[a:b], return_counts=True)
                numbers.append(number.astype(np.int32))
                values.append((count / np.sqrt(max(1, b - a))).astype(np.float32))
        ends = pa.array(np.cumsum([0, *(len(x) for x in numbers)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, t), *x]), kind)) for x, t, kind in ((numbers, np.int32, pa.int32()), (values, np.float32, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("turn"), batch.column("good"), *lists], ["shard", "turn", "good", "numbers", "values"])


def _learn(table: pa.Table) -> pa.Table:
    """FTRL-proximal over one shard's rows, in their turn."""
    order = np.argsort(table.column("turn").to_numpy(), kind="stable")
    good = table.column("good").to_numpy()
    numbers, values = (table.column(c).combine_chunks() for c in ("numbers", "values"))
    z, n = np.zeros(SIZE), np.zeros(SIZE)

    def weights(i):
        return np.where(np.abs(z[i]) > L1, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for row in order:
            i = np.append(numbers[int(row)].values.to_numpy(), 0)
            x = np.append(values[int(row)].values.to_numpy(), 1.0)
            w = weights(i)
            step = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - good[row]) * x
            z[i] += step - (np.sqrt(n[i] + step * step) - np.sqrt(n[i])) / ALPHA * w
            n[i] += step * step
    w = weights(np.arange(SIZE))
    used = np.flatnonzero(w)
    # one more number than there are weights counts the learners
    return pa.table({"number": pa.array(np.append(used, SIZE), pa.int32()), "weight": pa.array(np.append(w[used], 1.0))})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16384, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The model: ``SIZE`` weights. Labels are rows (id, 1 for good or 0), of which those
    without an id or a label teach nothing and use up none of ``max_rows``; neither do labels
    without a document. The
    bound ``max_rows`` on the labelled rows that are used also bounds what is broadcast:
    ids of these rows and, for scoring, the weights. Without labels all weights are 0."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), (F.col(f"`{label_col}`") == 1).cast("double").alias("good")).dropna()
    rows = keyed(docs, id_col, text_col).select("doc", "text")
    known = known.join(rows.select("doc"), "doc", "left_semi").orderBy(F.xxhash64("doc"), "doc", "good").limit(max_rows)
    rows = rows.join(F.broadcast(known), "doc")
    turn = F.xxhash64("doc")
    rows = rows.select("text", "good", turn.alias("turn"), F.pmod(turn, F.lit(SHARDS)).cast("int").alias("shard"))
    features = rows.mapInArrow(_features, "shard int, turn long, good double, numbers array<int>, values array<float>")
    learnt = features.groupBy("shard").applyInArrow(_learn, "number int, weight double")
    sums = learnt.groupBy("number").agg(F.sum("weight").alias("weight")).toArrow()
    model = np.zeros(SIZE + 1)
    model[sums.column("number").to_numpy()] = sums.column("weight").to_numpy()
    return model[:SIZE] / max(1.0, model[SIZE])


def _scorer(shared, keep_text):
    def job(batches):
        weights = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            scores = np.zeros(batch.num_rows)
            for i, j in blocks(offsets):
                g, r = grams(data, offsets[i : j + 1])
                total = np.bincount(r, weights[g], j - i) / np.sqrt(np.maximum(1, np.bincount(r, minlength=j - i)))
                scores[i:j] = 1 / (1 + np.exp(-np.clip(total + weights[0], -35, 35)))
            kept = [batch.column(c) for c in batch.schema.names if c == "row" or keep_text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*batch.schema.names[: len(kept)], "score"])

    return job


def score(spark: SparkSession, docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(row, score), or (row, text, score) with ``keep_text``, for every row of ``docs``: ``row`` has all its columns but the text,
    ``score`` lies between 0 and 1, higher where a label of 1 is likelier. Only the text
    counts. A null or empty text has the score of the constant alone; an empty model
    scores all texts 0.5. Repeated rows have equal scores."""
    rows = keyed(docs, id_col, text_col).select("row", "text")
    kept = {"text": StringType()} if keep_text else {}
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model), keep_text), result_schema(rows, **kept, score=DoubleType()))
