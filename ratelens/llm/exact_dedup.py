"""Exact deduplication by exchanging Golomb-coded fingerprints.

No text leaves its task before another one is likely to hold the same. (1) Each task
reduces its texts to fingerprints, and sends to every owner, which is a range of the
fingerprints, the sorted distinct ones that it holds there, as Golomb-coded gaps. (2) An
owner decodes what it was sent and answers each message with a bitmap: which of these
fingerprints another message holds as well. (3) Documents whose fingerprint is marked, or
that share it with another one of their own message, are suspects; only their texts are
shuffled, equal ones combined before the shuffle, and compared byte by byte.

A fingerprint has ``SLACK`` bits more than the number of documents has, so it costs about
SLACK + 2 bits to send, plus the logarithm of the number of messages of an owner, and
about one document in 2^SLACK is a suspect for nothing. A message holds each fingerprint
once, so a text that a third of all documents share costs an owner one entry for each
message. The number of owners grows with the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ratelens.llm.tables import keyed
from ratelens.llm.textblocks import U64
from ratelens.session import cut_lineage

SLACK, MOST_BITS = 8, 62
#: Documents in a message group, and fingerprints that an owner has to expect at most,
#: but for those that come in several messages.
CHUNK, PER_OWNER, LEAST_OWNERS = 1 << 17, 1 << 18, 64

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _CAPITALS, _SMALL)


def golomb_encode(values: np.ndarray, shift: int) -> tuple[bytes, bytes]:
    """Ascending distinct values as gaps in Golomb's code with the parameter 2^shift: the
    quotients in unary and the remainders in ``shift`` bits each, as two bit streams."""
    gaps = np.diff(values, prepend=U64(0))
    ends = np.cumsum((gaps >> U64(shift)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = (gaps[:, None] >> np.arange(shift, dtype=U64)) & U64(1)
    return np.packbits(unary).tobytes(), np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(unary: bytes, low: bytes, n: int, shift: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(U64)
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[: n * shift].reshape(n, shift).astype(U64)
    return np.cumsum((quotients << U64(shift)) + (bits << np.arange(shift, dtype=U64)).sum(axis=1, dtype=U64), dtype=U64)


def golomb_shift(n: int, width: int) -> int:
    """The parameter that suits n values spread over 2^width: near the mean gap."""
    return max(0, width - max(1, n).bit_length())


def _messages(bits: int, owners: int):
    width = bits - (owners - 1).bit_length()

    def encoded(prints: np.ndarray, docs: np.ndarray, chunk: int):
        order = np.argsort(prints, kind="stable")
        prints, docs = prints[order], docs[order]
        distinct, first, times = np.unique(prints, return_index=True, return_counts=True)
        owner = (distinct >> U64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(distinct)], strict=True):
            shift = golomb_shift(int(b - a), width)
            unary, low = golomb_encode(distinct[a:b] & U64((1 << width) - 1), shift)
            out.append((chunk, int(owner[a]), int(b - a), shift, unary, low, docs[first[a] : first[b - 1] + times[b - 1]].tolist(), times[a:b].tolist()))
        names = ["chunk", "owner", "n", "shift", "unary", "low", "docs", "times"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def job(batches):
        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append((batch.column("print").to_numpy(zero_copy_only=False).view(U64) >> U64(64 - bits), batch.column("doc").to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= CHUNK:
                yield encoded(*(np.concatenate(x) for x in zip(*held, strict=True)), chunk)
                chunk, held, n = chunk + 1, [], 0
        if n:
            yield encoded(*(np.concatenate(x) for x in zip(*held, strict=True)), chunk)

    return job


def _answers(messages: pa.Table) -> pa.Table:
    """An owner's bitmaps for the messages that it was sent."""
    sent = [golomb_decode(u, v, n, s) for u, v, n, s in zip(*(messages.column(c).to_pylist() for c in ("unary", "low", "n", "shift")), strict=True)]
    values, times = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[times > 1]
    maps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in sent]
    return pa.table({"chunk": messages.column("chunk"), "owner": messages.column("owner"), "shared": pa.array(maps, pa.binary())})


def _suspects(batches):
    for batch in batches:
        found = [np.zeros(0, np.int64)]
        for n, docs, times, shared in zip(*(batch.column(c) for c in ("n", "docs", "times", "shared")), strict=True):
            times = times.values.to_numpy()
            marked = np.unpackbits(np.frombuffer(shared.as_py(), np.uint8))[: n.as_py()].astype(bool) | (times > 1)
            found.append(docs.values.to_numpy()[np.repeat(marked, times)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["doc"])


def suspects(prints: DataFrame) -> DataFrame:
    """The ids (doc) of the rows (doc, print), two longs, whose fingerprint another row
    may have as well: all that share one are found, few others. Neither may be null."""
    n = prints.count()
    owners = 1 << (max(LEAST_OWNERS, -(-n // PER_OWNER)) - 1).bit_length()
    bits = min(MOST_BITS, max(n.bit_length(), owners.bit_length()) + SLACK)
    sent = prints.mapInArrow(_messages(bits, owners), "chunk long, owner int, n int, shift int, unary binary, low binary, docs array<long>, times array<int>")
    sent = cut_lineage(sent, "messages")
    coded = sent.select("chunk", "owner", "n", "shift", "unary", "low")
    answers = coded.groupBy("owner").applyInArrow(_answers, "chunk long, owner int, shared binary")
    marked = sent.select("chunk", "owner", "n", "docs", "times").join(answers, ["chunk", "owner"])
    return marked.select("n", "docs", "times", "shared").mapInArrow(_suspects, "doc long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the documents whose texts are identical after lower-casing A-Z only; of each
    group the row with the largest id stays.

    Returns (row, keep_id, group_size, kept, text_sha256) for every row of ``docs``:
    ``row`` has all its columns but the text (so extra columns clash with nothing),
    ``keep_id`` is the id of the row that stays, ``group_size`` counts the rows with the
    text, ``kept`` says whether ``keep_id`` is the row's own id, and ``text_sha256`` is the
    digest of the lower-cased text in UTF-8, in lower-case hex. Null text counts as empty,
    and empty texts are equal to each other. Texts of any length are read and compared
    whole. Rows without an id take part, but one with an id stays before them; where no
    row of a group has an id, ``keep_id`` is null and all are kept. Rows that repeat an id
    and a text count each, and are kept or dropped together; rows that repeat an id with
    different texts belong to different groups. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    digests = rows.select("doc", "row", F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))
    digests = cut_lineage(digests.withColumn("print", F.xxhash64("text_sha256")), "digests")
    found = cut_lineage(suspects(digests.where("doc is not null").select("doc", "print")).distinct(), "suspects")
    texts = rows.select("doc", "text")
    shuffled = texts.join(found, "doc", "left_semi").unionByName(texts.where("doc is null"))
    same = shuffled.groupBy(ascii_lower(F.col("text")).alias("text")).agg(F.max("doc").alias("keep_id"), F.count("*").alias("group_size"))
    same = cut_lineage(same.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    out = digests.join(same.withColumn("grouped", F.lit(True)), "text_sha256", "left")
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc"))
    return out.select("row", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("doc")).alias("kept"), "text_sha256")
