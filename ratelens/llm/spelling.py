"""Spelling variants by composing finite-state machines.

The vocabulary, as a minimised acceptor A, is composed with a transducer E of exactly one
edit and with A again; what A o E o A accepts are the near pairs. A common prefix leaves
the composed machine on its diagonal, and one that is long enough is an initial state of
its own: words of s and s + 1 letters that share their first s // 2 letters form one
partition, which accepts the pairs whose edit comes later. The same machine over reversed
words accepts those whose edit comes earlier. Each partition builds the acceptor of its
rests, and runs the composition from its initial state alone.

E is unambiguous: a deleted letter is not followed by an equal one, and of two replaced
letters the smaller one is on the left, so each pair is accepted once. States of A number
the words below them, so a pair is found as two ranks, and where both sides reach the same
state, all words below it pair off at once. A partition above ``LIMIT`` words is divided:
by its next letter, and by what is left of its words when the edit is made at once.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ratelens.llm.tables import keyed
from ratelens.session import cut_lineage

LIMIT = 1 << 16
#: Distinct words that a task holds before it hands their counts on, and letters of a
#: very long text that it reads at once.
HELD, STRETCH = 1 << 20, 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")


class Acceptor:
    """The minimised acyclic acceptor of ascending distinct words, which it numbers."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[str, int, int], ...]] = []  # letter, state, words before
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        path, before = [[False, []]], ""
        for word in words:
            n = 0
            while n < len(before) and n < len(word) and before[n] == word[n]:
                n += 1
            self._close(path, n)
            for letter in word[n:]:
                path[-1][1].append((letter, -1))
                path.append([False, []])
            path[-1][0] = True
            before = word
        self._close(path, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, n: int) -> None:
        """End the branch below the n-th letter: its states can't change any more."""
        while len(path) > n + 1:
            state = self._state(*path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], state)

    def _state(self, final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.final)
            total, numbered = int(final), []
            for letter, to in arcs:
                numbered.append((letter, to, total))
                total += self.count[to]
            self.final.append(final)
            self.arcs.append(tuple(numbered))
            self.count.append(total)
        return state


def compose(a: Acceptor) -> list[tuple[int, int, int]]:
    """The pairs that a o E o a accepts, as (rank, rank, how many pairs in a row)."""
    final, arcs, count, out = a.final, a.arcs, a.count, []
    diagonal = [(a.start, 0)]
    while diagonal:
        state, rank = diagonal.pop()
        here, edited = arcs[state], []
        for i, (letter, to, n) in enumerate(here):
            if count[to] > 1:
                diagonal.append((to, rank + n))
            edited.append((to, rank + n, state, rank, letter))  # the letter is deleted
            for _, other, m in here[i + 1 :]:  # or replaced
                edited.append((to, rank + n, other, rank + m, ""))
        while edited:
            x, i, y, j, barred = edited.pop()
            if x == y:  # only after a replacement
                out.append((i, j, count[x]))
                continue
            if final[x] and final[y]:
                out.append((i, j, 1))
            left, right = arcs[x], arcs[y]
            if len(left) == 1 and len(right) == 1:
                if left[0][0] == right[0][0] != barred:
                    edited.append((left[0][1], i + left[0][2], right[0][1], j + right[0][2], ""))
                continue
            there = {c: (to, n) for c, to, n in right}
            for c, to, n in left:
                if c != barred and c in there:
                    edited.append((to, i + n, there[c][0], j + there[c][1], ""))
    return out


def near_in_partition(way: str, s: int, depth: int, edit: str, words: list[str]) -> list[tuple[int, int]]:
    """The near pairs of one partition as places in ``words``: ascending distinct words,
    reversed where ``way`` is ``<``, that share their first ``depth`` letters; the pairs
    whose shorter word has s letters and which the other way does not find. ``edit`` says
    that the words of the partition are equal after one replacement or deletion."""
    if edit == "r":
        pairs = list(itertools.combinations(range(len(words)), 2))
    elif edit == "d":
        short = [i for i, w in enumerate(words) if len(w) == s]
        pairs = [(i, j) for i in range(len(words)) for j in short if i != j]
    else:
        pairs = [(i + n, j + n) for i, j, k in compose(Acceptor([w[depth:] for w in words])) for n in range(k)]
    half = s // 2
    return [
        (i, j)
        for i, j in pairs
        if (len(words[i]) == s or len(words[j]) == s) and (way == ">" or words[i][: -half - 1 : -1] != words[j][: -half - 1 : -1])
    ]


_PARTITION = ["way", "s", "depth", "edit", "start"]


def _composed(batches):
    names = ["a", "a_n", "b", "b_n"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]

    def groups():
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            held = held.combine_chunks()
            new = np.zeros(held.num_rows, bool)
            new[0] = True
            for c in _PARTITION:
                column = held.column(c).chunk(0)
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(new)
            yield held.slice(0, int(cuts[-1])), cuts
            held = held.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield held, np.zeros(1, np.int64)

    for table, cuts in groups():
        ends = np.append(cuts[1:], table.num_rows) if cuts[-1] < table.num_rows else cuts[1:]
        many = np.flatnonzero(ends - cuts[: len(ends)] > 1)
        if not len(many):
            continue
        words, counts = table.column("oriented").to_pylist(), table.column("n").to_numpy()
        partition = [table.column(c).to_pylist() for c in _PARTITION[:4]]
        out = []
        for a, b in zip(cuts[many].tolist(), ends[many].tolist(), strict=True):
            turn = -1 if partition[0][a] == "<" else 1
            for i, j in near_in_partition(*(p[a] for p in partition), words[a:b]):
                out.append((words[a + i][::turn], int(counts[a + i]), words[a + j][::turn], int(counts[a + j])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _partition(rows: DataFrame, way: str, s: Column, depth: Column, edit: str, start: Column) -> DataFrame:
    return rows.select(F.lit(way).alias("way") if way else "way", s.cast("int").alias("s"), depth.cast("int").alias("depth"), F.lit(edit).alias("edit"), start.alias("start"), "oriented", "n")


def _divided(big: DataFrame) -> DataFrame:
    """Partitions as smaller ones: by the next letter, or equal after an edit there."""
    d, u, s = F.col("depth"), F.col("oriented"), F.col("s")
    rest = F.substring(u, d + 2, F.length(u))
    longer = big.where(F.length(u) > d)
    deeper = _partition(longer, "", s, d + 1, "", F.substring(u, F.lit(1), d + 1))
    replaced = _partition(longer.where(F.length(u) == s), "", s, d, "r", F.concat("start", F.lit("*"), rest))
    plain = F.substring(u, d + 1, F.lit(1)) != F.substring(u, d + 2, F.lit(1))  # not followed by an equal letter
    long = _partition(longer.where((F.length(u) == s + 1) & plain), "", s, d, "d", F.concat("start", rest))
    short = _partition(big.where(F.length(u) == s), "", s, d, "d", u)
    return deeper.unionByName(replaced).unionByName(long).unionByName(short)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, a_n, b, b_n), each once, of the distinct words (word, n) that differ by
    exactly one inserted, deleted or replaced code point."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s")).where("s > 0")
    half = F.floor(F.col("s") / 2)
    forward = rows.withColumn("oriented", F.col("word"))
    backward = rows.withColumn("oriented", F.reverse("word"))
    begin = lambda d: F.substring(F.col("oriented"), F.lit(1), d.cast("int"))
    rows = _partition(forward, ">", F.col("s"), half, "", begin(half)).unionByName(_partition(backward, "<", F.col("s"), F.col("s") - half, "", begin(F.col("s") - half)))
    rows = cut_lineage(rows, "partitions")
    while True:
        big = cut_lineage(rows.where("edit = ''").groupBy(*_PARTITION).agg(F.count("*").alias("size")).where(F.col("size") > limit).drop("size"), "large")
        if big.isEmpty():
            break
        small = rows.join(big, _PARTITION, "left_anti")
        rows = cut_lineage(small.unionByName(_divided(rows.join(big, _PARTITION, "left_semi"))), "partitions")
    ordered = rows.repartition(*(F.col(c) for c in _PARTITION)).sortWithinPartitions(*_PARTITION, "oriented")
    return ordered.select(*_PARTITION, "oriented", "n").mapInArrow(_composed, "a string, a_n long, b string, b_n long")


def _stretches(text: str):
    """A very long text in pieces that end between words."""
    at = 0
    while len(text) - at > STRETCH:
        to = at + STRETCH
        while to < len(text) and _RUN.match(text, to):
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _tallied(divisor: int, shortest: int):
    def job(batches):
        tally: Counter = Counter()

        def counts():
            out = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])
            tally.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                before = zlib.crc32(b":" if doc is None else f"{doc}:".encode())
                for part in _stretches(text.encode().lower().decode()):
                    for run, n in Counter(_RUN.findall(part)).items():
                        h = zlib.crc32(run.encode(), before)
                        if h % divisor == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        if len(run) >= shortest:
                            tally[run] += n
                if len(tally) > HELD:
                    yield counts()
        if tally:
            yield counts()

    return job


def vocabulary(docs: DataFrame, least: int = 3, shortest: int = 5, divisor: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct words (word, n) of all texts, n their occurrences, ``least`` of them.
    Words are the runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. With h, the
    crc32 of ``<id>:<run>``, a run whose h ``divisor`` divides loses its letter h modulo
    its length: misspellings for tests, made of the data. Words of fewer than ``shortest``
    letters are left out. Null texts have no words; a missing id is written as nothing."""
    rows = keyed(docs.select(id_col, text_col), id_col, text_col).select("doc", "text")
    return rows.mapInArrow(_tallied(divisor, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form (word, form), by doubling pointers."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = cut_lineage(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = after.drop("moved")
        if after.where("moved").isEmpty():
            return links


def spelling_variants(words: DataFrame, times: int = 2, limit: int = LIMIT) -> DataFrame:
    """Group the distinct words (word, n) by spelling. Two words are near if they differ by
    exactly one inserted, deleted or replaced code point. The form of a word is its near
    word of largest n, the first in code-point order of several, if that n is at least
    ``times`` (2 or more) the word's own.

    Returns (word, form, root, n, n_near, form_n) for every word: ``root`` is reached from
    the word over forms, and the word itself where it has none; ``n_near`` counts its near
    words; ``form`` and ``form_n`` are null where there is none. No word, or no near words,
    give an empty result, or roots that are the words. Words may be of any length; they
    must not repeat, and neither column may be null. ``vocabulary`` makes such words of
    documents with nulls, repeated rows and further columns."""
    words = cut_lineage(words.select("word", "n"), "vocabulary")
    pairs = cut_lineage(near_words(words, limit), "near")
    both = pairs.unionByName(pairs.toDF("b", "b_n", "a", "a_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left").withColumn("_has", F.coalesce(-F.col("best.n") >= times * F.col("n"), F.lit(False)))
    out = out.select("word", F.when(F.col("_has"), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_has"), -F.col("best.n")).alias("form_n"))
    out = cut_lineage(out, "forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
