"""The training-data operators against brute force, and on awkward input."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratelens.llm import decontaminate, minhash_dedup, mixing, quality, token_counts, url_filter
from ratelens.llm.components import components
from ratelens.llm.line_dedup import line_dedup
from ratelens.llm.minhash_dedup import near_duplicates
from ratelens.llm.neighbours import neighbours
from ratelens.llm.queries import RULES
from ratelens.llm.substring_dedup import substring_dedup
from ratelens.llm.suffix_dedup import suffix_dedup
from ratelens.session import configure, cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, self-repeats, and awkward texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(30)]
    passage = prose(rng, 70)
    texts += [texts[0], texts[0], texts[1], f"{texts[2]} {passage} {texts[3]}", f"{texts[4][:90]} {passage}", f"{passage}\n{passage}"]
    for base in (texts[5], texts[6]):
        for _ in range(4):
            w = base.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    lines = [prose(rng, 6) for _ in range(12)]
    texts += ["\n".join(lines), "\n".join(lines[3:9]), "\n \n".join(lines[2:7]), "\n".join([lines[0]] * 9), "A\r\nb\n\nA\nb\nA"]
    texts += ["", None, " \t\n", "one", "ONE", "two words", "x" * 300, "y" * 300 + "x" * 200, "\u00a0" * 120]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in corpus], SCHEMA).repartition(5)


def cover(sequences, length, across):
    """For (id, symbols): which symbols lie in windows that also start earlier."""
    seen, out = {}, {}
    for i, s in sequences:
        mask = [False] * len(s)
        for p in range(len(s) - length + 1):
            w = tuple(s[p : p + length])
            if (seen.setdefault(w, i) < i) if across else (w in seen):
                mask[p : p + length] = [True] * length
            seen.setdefault(w, i)
        out[i] = mask
    return out


def test_bytes_that_repeat(docs, corpus):
    want = cover([(i, (t or "").encode()) for i, t in corpus], 100, across=False)
    got = {r.row.doc_id: r for r in suffix_dedup(docs).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        kept = bytes(b for b, m in zip((t or "").encode(), want[i], strict=True) if not m)
        assert (bytes(got[i].kept), got[i].n_removed, got[i].n_bytes) == (kept, sum(want[i]), len(want[i])), i
        assert got[i].n_spans == sum(m and not (p and want[i][p - 1]) for p, m in enumerate(want[i]))


def test_words_that_repeat(docs, corpus):
    want = cover([(i, WORDS.findall(t or "")) for i, t in corpus], 50, across=True)
    got = {r.row.doc_id: r for r in substring_dedup(docs).collect()}
    for i, t in corpus:
        kept = " ".join(w for w, m in zip(WORDS.findall(t or ""), want[i], strict=True) if not m)
        assert (got[i].kept, got[i].n_removed, got[i].n_words) == (kept, sum(want[i]), len(want[i])), i


def cover_lines(sequences, run=3, long_words=50):
    """For (id, lines): which lines lie in runs that count and also start earlier; all
    runs of any length are tried."""
    seen, out = set(), {}
    for i, s in sequences:
        mask, new = [False] * len(s), []
        for p in range(len(s)):
            for q in range(p + 1, len(s) + 1):
                kinds = [True] * (q - p == len(s)) + [False] * (q - p >= run or sum(len(WORDS.findall(x)) for x in s[p:q]) >= long_words)
                for key in ((whole, tuple(s[p:q])) for whole in kinds):
                    if key in seen:
                        mask[p:q] = [True] * (q - p)
                    new.append(key)
            seen.update(new)  # runs that start at p are earlier than those at p + 1
            new = []
        out[i] = mask
    return out


def full_lines(text):
    return [(n, x.strip(" \t\r")) for n, x in enumerate((text or "").split("\n")) if x.strip(" \t\r")]


def test_lines_that_repeat(spark, corpus):
    rng = random.Random(3)
    two, far = prose(rng, 30), prose(rng, 55)
    more = [far, f"short\n{far} ", f"short\n{far}", f"{two}\n{two}x", f"before\n\n{two}\n \t\n{two}x\nafter", f"{far}\n\n{far}", "ONE", "few words\nhere", "few words \n\n\there", "few words\nhere\nand more", "\x0b", "\x0b"]
    corpus = [*corpus, *enumerate(more, 5000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in corpus], SCHEMA).repartition(5)
    numbered = {i: full_lines(t) for i, t in corpus}
    want = cover_lines([(i, [x for _, x in numbered[i]]) for i, _ in corpus])
    got = {r.row.doc_id: r for r in line_dedup(docs).collect()}
    for i, t in corpus:
        gone = {n for (n, _), m in zip(numbered[i], want[i], strict=True) if m}
        assert got[i].kept == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone), i
        assert (got[i].n_removed, got[i].n_lines) == (len(gone), len(numbered[i]))


def similar(corpus, k):
    """Brute force: shingle sets, and the smallest id reachable over similar texts."""
    low = {i: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in corpus}
    sets = {i: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for i, w in low.items()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return sets, root


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, corpus, k):
    sets, root = similar(corpus, k)
    got = {r.row.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k=k).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_a_chain_of_copies_is_one_group(spark):
    """Each text is near the next one only."""
    words = [f"w{i}" for i in range(460)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


@pytest.mark.parametrize("part", [2, 7, 64])
def test_open_buckets_are_compared_in_tiles(docs, corpus, monkeypatch, part):
    """However a bucket is cut, each pair of different components is met once, and no row
    is made of a pair in Spark."""
    rng = np.random.default_rng(part)
    n = 60
    doc, component = np.arange(n), rng.integers(0, 12, n)
    bits = rng.integers(0, 2**63, (1, 64)).astype(np.uint64).repeat(n, 0)
    bits[::3] ^= rng.integers(0, 2**63, (20, 64)).astype(np.uint64)  # every third is far from all
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    parts = -(-n // part)
    rows = [(0, min(d % parts, w), max(d % parts, w), d % parts, component[d], d) for d in doc for w in range(parts)]
    rows = np.array(sorted(map(tuple, rows)), np.int64)
    c = dict(zip(["band", "i", "j", "part", "component", "doc"], rows.T, strict=True))
    at = c["doc"]
    c |= {"size": ones[at], "taken": np.zeros(len(at), np.int64), "s0": np.zeros(len(at), np.uint64), "s1": np.zeros(len(at), np.uint64), "map": bits[at]}
    monkeypatch.setattr(minhash_dedup, "AT_ONCE", 50)
    cuts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1), len(rows)]
    got = [pair for k, e in zip(cuts[:-1], cuts[1:], strict=True) for pair in zip(*(x.tolist() for x in minhash_dedup.near_in_tiles({name: x[k:e] for name, x in c.items()}, 80)), strict=True)]
    assert sorted(got) == sorted(zip(*(x.tolist() for x in minhash_dedup.near_in_tiles(c, 80)), strict=True))
    common = np.bitwise_count(bits[:, None] & bits[None]).sum(axis=2, dtype=np.int64)
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if component[a] != component[b] and 100 * common[a, b] >= 80 * (ones[a] + ones[b] - common[a, b])]
    assert sorted(got) == want and want

    if part == 2:
        monkeypatch.setattr(minhash_dedup, "PART", part)
        sets, root = similar(corpus, 4)
        assert {r.row.doc_id: r.component_id for r in near_duplicates(docs, k=4).collect()} == {i: root[i] for i in sets}


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


def test_contained_items(spark, corpus):
    rng = random.Random(6)
    items = [(n, prose(rng, size)) for n, size in enumerate([5, 9, 20, 33, 60, 60])] + [(6, "four words are few"), (7, None), (None, prose(rng, 20)), (8, "")]
    held = [(100 + n, f"{prose(rng, 200)} {t.upper()}! {prose(rng, 900)}") for n, t in items[:5]]
    part = items[5][1].split()
    held += [(200, f"{prose(rng, 50)} {' '.join(part[:50])}"), (201, f"{prose(rng, 50)} {' '.join(part[:40])}"), (100, held[0][1]), (None, items[4][1])]
    docs = spark.createDataFrame([*corpus, *held], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[p : p + 5]) for p in range(len(w) - 4)}

    want = {(d, i) for d, t in [*corpus, *held] for i, x in items if d is not None and i is not None and shingles(x) and len(shingles(x) & shingles(t)) * 100 >= 80 * len(shingles(x))}
    assert set(got) == want and (200, 5) in want and (201, 5) not in want
    kept = decontaminate.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(d for d, _ in [*corpus, *held] if d not in {x for x, _ in want})


def test_items_of_a_few_words(spark):
    docs = [(1, "It says: Blue, whale. End"), (2, "bluewhale blue"), (3, "a whale blue"), (4, "blue"), (5, None), (None, "blue whale"), (6, "one two three four five"), (6, "blue whale")]
    items = [(1, "blue whale!"), (2, "BLUE"), (3, "one two three four"), (4, "two four"), (5, ""), (6, None), (None, "blue"), (7, "one two three four five")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contained(docs, items).collect())
    want = [(1, 1), (1, 2), (2, 2), (3, 2), (4, 2), (6, 1), (6, 2), (6, 3), (6, 7)]
    assert got == [(d, i, 1, 1, 1.0) for d, i in want]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect() if r.doc_id] == [5]


def test_mix_keeps_to_the_weights(spark):
    shares = {"a": 5, "b": 3, "c": 1, "": 2}
    rows = [(i, "x" * (40 + i % 30), s or None) for i, s in enumerate(s for s in shares for _ in range(600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, spark.createDataFrame(list(shares.items()), "source string, share long"), block=50).collect()
    assert sorted(r.row.doc_id for r in got) == list(range(2400))
    slots = {(r.source, r.block): r.slot for r in got}
    assert len(set(slots.values())) == len(slots)
    for s, share in shares.items():
        for (_, block), slot in ((x, y) for x, y in slots.items() if x[0] == s):
            assert block * 11 // share <= slot < -(-(block + 1) * 11 // share)  # less than one block off
        places = sorted((r.place, len(r.row.text)) for r in got if r.source == s)
        assert all(p + n == q for (p, n), (q, _) in zip(places, places[1:], strict=False))


def test_period_is_earliest_deadline_first(spark, monkeypatch):
    """Halved down to groups of 4, in chunks of 7 slots, against a queue in plain Python."""
    monkeypatch.setattr(mixing, "LEAF", 4)
    monkeypatch.setattr(mixing, "SLOT_CHUNK", 7)
    rng = random.Random(4)
    for shares in ({"a": 1}, {"a": 5, "b": 3, "c": 1, "": 2}, {f"s{i}": rng.choice([1, 1, 2, 40]) for i in range(15)}):
        total, done, want = sum(shares.values()), dict.fromkeys(shares, 0), {}
        for t in range(total):
            ready = [(-(-(done[s] + 1) * total // a), s) for s, a in shares.items() if done[s] * total // a <= t]
            due, s = min(ready)
            assert t < due
            want[s, done[s]] = t
            done[s] += 1
        got = mixing.period(spark.createDataFrame(list(shares.items()), "source string, share long")).collect()
        assert {(r.source, r.k): r.slot for r in got} == want and len(got) == total
        assert all((r.share, r.total) == (shares[r.source], total) for r in got)
    assert mixing.period(spark.createDataFrame([], "source string, share long")).count() == 0


def test_mix_of_many_sources_and_rows_without_id(spark):
    """More sources than one task could schedule by hand; rows without an id are spread."""
    n = 5000
    ids = F.when(F.col("id") < n, F.col("id"))
    docs = spark.range(2 * n).select(ids.alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") < n, F.concat(F.lit("s"), F.col("id"))).otherwise("hot").alias("source"))
    assert mixing.root_shares(docs).agg(F.sum("share")).first()[0] >= mixing.PER_SOURCE * n * 0.9
    got = mixing.mixed(docs, block=5).select("row.*", "block", "slot", "place").collect()
    assert len(got) == 2 * n and len({r.text for r in got}) == 2 * n
    slots = {(r.source, r.block): r.slot for r in got}
    assert len(set(slots.values())) == len(slots)
    hot = sorted((r.place, len(r.text), r.text) for r in got if r.source == "hot")
    assert all(p + size == q for (p, size, _), (q, _, _) in zip(hot, hot[1:], strict=False))
    assert [t for _, _, t in hot] != sorted(t for _, _, t in hot)


def test_default_shares_and_empty_sources(spark):
    docs = spark.createDataFrame([(i, "t", "big" if i else None) for i in range(101)], "doc_id long, text string, source string")
    assert {r.source: r.share for r in mixing.root_shares(docs).collect()} == {"big": 909, "": 91}
    assert all(0 <= r.slot < 11 for r in mixing.mixed(docs, block=1).collect() if r.source == "")


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, size=(1200, 1))
    x[50:400] = x[40]  # a third are copies
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None] + [1.0] * 23), (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame([*rows, *odd, rows[7]], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(neighbours(df, df.where("vec_id % 20 = 0"), part=100).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    e = np.array([v for _, v in rows])
    hit = 0
    assert set(got) == set(range(0, 1200, 20))
    for q in got:
        s = [sum(a * b for a, b in zip(e[q], v, strict=True)) for v in e]
        want = sorted((i for i in range(1200) if i != q), key=lambda i: (-s[i], i))[:20]
        assert all(abs(score - s[v]) < 1e-12 for v, score in got[q]) and got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        hit += len(set(want) & {v for v, _ in got[q]})
    assert hit >= 0.9 * 20 * len(got)


def recall(found, x, queries, k=20):
    """The share of the true neighbours by brute force; row numbers are ids."""
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    return np.mean([len(got[q] & set(np.argsort(-row)[:k].tolist())) / k for q, row in zip(queries, s, strict=True)])


@pytest.mark.parametrize("times", [5, 100, 1e200])
def test_recall_beside_a_long_vector(spark, times):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[77] *= times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    queries = list(range(0, 2000, 20))
    found = recall(neighbours(df, df.where("vec_id % 20 = 0"), part=500), x, queries)
    assert found >= 0.97, found


def test_few_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = neighbours(df, df.where("vec_id = 20"), tables=16, probes=64).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert neighbours(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [15, 21, 6000])
def test_no_query_comes_back_short(spark, n):
    """Small tables, and a large one in which all vectors point away from the queries."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 64))
    if n > 21:
        x = x * 1e-3 + np.eye(64)[0]
        x[::1000] = -np.eye(64)[0] + x[::1000] * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = list(range(0, n, 1000 if n > 21 else 1))
    got = neighbours(df, df.where(F.col("vec_id").isin(queries)))
    k = min(20, n - 1)
    assert collections.Counter(r.query_id for r in got.collect()) == dict.fromkeys(queries, k)
    assert recall(got, x, queries, k) == 1


def test_neighbours_of_repeated_ids(spark):
    """Ids on twenty rows, with near and with equal vectors; one on many equal rows."""
    rng = np.random.default_rng(13)
    centre = rng.normal(size=(60, 24))
    rows = [(i, (centre[i] + 1e-3 * rng.normal(size=24)).tolist()) for i in range(60) for _ in range(20)]
    rows += [(0, rows[0][1])] * 30 + [(100, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(neighbours(df, df.where("vec_id % 7 = 0")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in range(0, 60, 7):
        s = (x[ids == q] @ x.T).max(0)
        best = {int(i): s[ids == i].max() for i in set(ids) - {q}}
        assert got[q] == sorted(best, key=lambda i: (-best[i], i))[:20], q
    assert 100 in got[0]


URLS = ["http://www.example.org/es/12?x", "https://EXAMPLE.org/en/1", "http://example.org/en/2#a", "http://org", "org/", "ftp://a.com/fr/x", "x://com/de/", "http://xcom/de/", "http://a.b.example.org/es", None, "", "://", "http://a.com?x=/fr/", "http://ex.org:80/es/", "http://É.org/a\nb"]


@pytest.mark.parametrize("split_rows", [1, 100_000])
def test_url_rules(spark, split_rows):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    rules = spark.createDataFrame([*RULES, ("example.org", "/en/1", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, rules, split_rows=split_rows).collect()}
    for i, u in enumerate(URLS * 2):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[1:] if fits else (None, "allow"))), u


def test_url_filter_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judged(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block").collect()] == ["block"]


def test_quality_is_learnt(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) if i % 4 else " ".join(f"{w}&&&" for w in prose(rng, 60).split()) for i in range(400)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.row.doc_id: r.score for r in quality.score(spark, docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 4) for i in range(200, 400))
    assert 0 <= got[400] <= 1 and got[400] == got[401]
    assert np.array_equal(model, quality.fit(docs.repartition(2), labels)) or np.allclose(model, quality.fit(docs.repartition(2), labels))
    assert np.count_nonzero(quality.fit(docs, labels.limit(0))) == 0


def _plain_scores(texts, good, hashes):
    """FTRL and sparse scores in plain Python; only the numbers of the n-grams come from
    the operator, one word or pair at a time."""
    numbers = {}

    def number(gram):
        if gram not in numbers:
            data = np.frombuffer(gram.encode(), np.uint8)
            numbers[gram] = int(quality.grams(data, np.array([0, len(data)]))[0][-1])
        return numbers[gram]

    def features(text):
        w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x00-\x20]+", text or "")
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        return {0: 1.0, **{i: float(np.float32(n / max(1, len(grams)) ** 0.5)) for i, n in collections.Counter(map(number, grams)).items()}}

    x = {i: features(t) for i, t in texts.items()}
    learners = []
    for shard in range(quality.SHARDS):
        z, n = collections.defaultdict(float), collections.defaultdict(float)

        def weight(i, z=z, n=n):
            if abs(z[i]) <= quality.L1:
                return 0.0
            return ((quality.L1 if z[i] > 0 else -quality.L1) - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

        rows = sorted((i for i in good if hashes[i] % quality.SHARDS == shard), key=hashes.get)
        for i in rows * quality.EPOCHS:
            w = {j: weight(j) for j in x[i]}
            error = 1 / (1 + math.exp(-sum(w[j] * v for j, v in x[i].items()))) - good[i]
            for j, v in x[i].items():
                step = error * v
                z[j] += step - ((n[j] + step * step) ** 0.5 - n[j] ** 0.5) / quality.ALPHA * w[j]
                n[j] += step * step
        if rows:
            learners.append({j: weight(j) for j in list(z)})
    return {i: 1 / (1 + math.exp(-sum(v * sum(m.get(j, 0.0) for m in learners) / max(1, len(learners)) for j, v in f.items()))) for i, f in x.items()}


@pytest.mark.parametrize("labelled", [120, 3])
def test_quality_scores_against_plain_python(spark, labelled):
    rng = random.Random(21)
    texts = {i: prose(rng, rng.randrange(1, 50), 30) + rng.choice(["", " && !", "\nso so so", " 12ab"]) for i in range(160)} | {160: "", 161: None, 162: " \n\t "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    good = {i: int(rng.random() < 0.6) for i in range(labelled)}
    model = quality.fit(docs, spark.createDataFrame(list(good.items()), "doc_id long, quality int"))
    got = {r.row.doc_id: r.score for r in quality.score(spark, docs, model).collect()}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = _plain_scores(texts, good, hashes)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    assert len({round(s, 3) for s in got.values()}) > 5 and got[160] == got[161] == got[162]


def test_labels_without_a_document_take_no_place(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "&&& bad &&&") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, max_rows=40)
    assert np.array_equal(model, quality.fit(docs, labels.where("doc_id < 40"), max_rows=40)) and np.count_nonzero(model)


def test_tokens_add_up(docs, corpus):
    tokens = token_counts.encoder(token_counts.RANKS, token_counts.PATTERN)
    got = collections.defaultdict(list)
    for r in token_counts.token_counts(docs).collect():
        got[r.row.doc_id].append(r)
    for i, t in corpus:
        text, rows = t or "", sorted(got[i], key=lambda r: r.section)
        ids = tokens.encode_ordinary(text)
        assert "".join(text[r.start_char : r.end_char] for r in rows) == text
        firsts = np.cumsum([0] + [len(tokens.decode_single_token_bytes(x)) for x in ids])[:-1]
        for r in rows:
            a, b = (len(text[:c].encode()) for c in (r.start_char, r.end_char))
            assert r.n_tokens == sum(a <= f < b for f in firsts)
            assert r.n_crossing == sum(a <= f < b < f + len(tokens.decode_single_token_bytes(x)) for f, x in zip(firsts, ids, strict=True))


AWKWARD = [(None, None, None, None, None, 1), (1, None, "en", None, None, 2), (1, "a b c", None, "s", 5, 3), (1, "a b c", None, "s", 5, 3), (None, "a b c", None, "s", 5, 3), (2, "a b c", "en", "s", 5, None)]
CLASH = ", doc long, row string, kept string, spans string, size long, slot long, source2 string, _hit string, gone string, mix_slot string, key string"


def single(spark):
    bad = spark.createDataFrame([("a", "b", "c")], "host string, path string, verdict string")
    items = spark.createDataFrame([(None, None), (1, "a b c d e"), (1, "a b c d e")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    return {
        "suffix": lambda d: suffix_dedup(d),
        "substring": lambda d: substring_dedup(d),
        "line": lambda d: line_dedup(d),
        "near": lambda d: near_duplicates(d),
        "contained": lambda d: decontaminate.decontaminated(d, items),
        "mixed": lambda d: mixing.mixed(d),
        "quality": lambda d: quality.score(spark, d, quality.fit(d, labels)),
        "tokens": lambda d: token_counts.token_counts(d).where("section = 0"),
        "urls": lambda d: url_filter.judged(d.withColumnRenamed("text", "url"), bad),
    }


@pytest.mark.parametrize("name", ["suffix", "substring", "line", "near", "contained", "mixed", "quality", "tokens", "urls"])
def test_awkward_tables(spark, name):
    """Nulls anywhere, repeated rows and ids, very long texts, clashing columns, no rows."""
    job = single(spark)[name]
    long = "ab " * 400_000 + "x" * 300_000
    rows = [(*r, "row", "kept", "spans", 1, 2, "z", "h", "g", "m", "k") for r in AWKWARD] + [(7, long, "en", "s", 1, 1, "row", "kept", "spans", 1, 2, "z", "h", "g", "m", "k")]
    df = spark.createDataFrame(rows, SCHEMA + CLASH)
    assert job(df).count() == len(rows)
    assert job(df.limit(0)).count() == 0


def test_stock_phrases_make_no_candidates(spark, monkeypatch):
    """Items and documents that share one stock phrase meet only by their other words."""
    rng, stock = random.Random(12), "which of the following is"
    items = [(i, f"{stock} {prose(rng, 12, 10**6)}") for i in range(60)]
    texts = [(i, f"{prose(rng, 30, 10**6)} {stock} {prose(rng, 30, 10**6)}") for i in range(60)] + [(100, f"x {items[7][1]} y")]
    made = []
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda df, name: made.append(df.count()) or df)
    got = decontaminate.contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(100, 7)] and made == [1]


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, repeated ids, clashing names and no rows at all, in every stage."""
    long = "ab " * 100_000 + "cd"
    rows = [(*r, "row", "kept", "spans", 1, 2, "z", "h", "g", "m", "k") for r in [*AWKWARD, (7, long, "en", "s", 1, 1)]]
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, "p q r s t u"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA + CLASH)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    # of the copies, 1 stays in both its rows, 2 goes with the line stage; rows without an id stay
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(True, 0, ""), (True, 0, "a b c"), (False, 1, ""), (False, 1, "a b c"), (False, 1, "a b c"), (False, 7, long)], key=str)
    assert docs.columns.count("mix_slot") == 1


def test_pipeline(spark, corpus, tmp_path):
    """Every stage against brute force on its own input, then all of them."""
    rng = random.Random(9)
    junk = [(1000 + i, " ".join(f"{w}&&&" for w in prose(rng, 40).split())) for i in range(40)]
    held = [(2000, f"{prose(rng, 30)} the test item has exactly these nine words {prose(rng, 30)}")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in [*corpus, *junk, *held]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in corpus[:30]] + [(i, 0, 0) for i, _ in junk[:20]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the test item has exactly these nine words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        seen[name] = (before, after)
    before, after = seen["quality_classifier"]
    assert not set(after) & {i for i, _ in junk} and {i for i, _ in corpus[:30]} <= set(after)
    before, after = seen["line_dedup"]
    want = cover_lines([(i, [x for _, x in full_lines(before[i].text)]) for i in sorted(before)])
    assert set(before) - set(after) == {i for i, m in want.items() if m and all(m)}
    assert all((after[i].text == (before[i].text or "")) == (not any(want[i])) and (not any(want[i]) or after[i].n_chars == len(after[i].text)) for i in after)
    before, after = seen["minhash_near_dedup"]
    _, root = similar([(i, before[i].text) for i in before], 5)
    assert set(after) == {i for i in before if root[i] == i}
    before, after = seen["decontamination"]
    assert set(before) - set(after) == {2000}
    before, after = seen["source_mixing"]
    assert set(before) == set(after) and all(after[i].text == before[i].text and after[i].mix_slot >= 0 for i in after)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest(), r.mix_slot) for r in final.collect()} == {(i, hashlib.md5((r.text or "").encode()).hexdigest(), r.mix_slot) for i, r in after.items()}
    assert final.where(F.col("mix_block") < 0).count() == 0


def test_only_windows_with_a_repeated_core_are_compared(spark, monkeypatch):
    from ratelens.llm import repeats

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared, long = [word(50) for _ in range(8)], word(400)
    short = [(i, word(150) + shared[i % 8] + word(150)) for i in range(40)]
    edited = [(100 + i, word(60) + long[:90 + 9 * i] + "#" + long[90 + 9 * i:] + word(30)) for i in range(20)]
    written = {}

    def counted(df, name):
        out = cut_lineage(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "cut_lineage", counted)
    got = {r.row.doc_id: r for r in suffix_dedup(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert all(r.n_removed == 0 for r in got.values()) and written["dictionary"] > written["varied"] > 0
    assert written["windows"] == 0  # 50 bytes are no window of 100, nor the core of one
    got = {r.row.doc_id: r for r in suffix_dedup(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    assert written["windows"] > 0
    seen = set()
    for i, text in edited:
        gone = set()
        for at in range(len(text) - 99):
            if text[at : at + 100] in seen:
                gone.update(range(at, at + 100))
            seen.add(text[at : at + 100])
        assert bytes(got[i].kept) == "".join(c for j, c in enumerate(text) if j not in gone).encode()


def test_spans_are_written_before_the_texts_are_joined_to_them(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 30), (2, "abcdefghij" * 30), (3, "short")], "doc_id long, text string")
    found = suffix_dedup(docs)
    read = {f.split("/")[-2].rsplit("-", 1)[0] for f in found.inputFiles()}
    assert read == {"spans"}
    assert {r.row.doc_id: r.n_removed for r in found.collect()} == {1: 290, 2: 300, 3: 0}


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    configure(spark)
    texts = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 24 << 20 and max(found) <= 10 << 20
