"""Exact deduplication, spelling variants and lexical search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import exact_dedup, lexical_search, spelling

AWKWARD = "doc_id long, text string, lang string, row string, text_sha256 string, keep_id long, m long, part long, item long"


def lowered(t):
    return re.sub("[A-Z]", lambda c: c[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = [f"w{i}é" for i in range(60)] + ["Straße", "ÀÉ", "房價", "it's", "a1b2"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 90])))) for i in range(150)]
    rows += [(200 + i, rows[i][1].upper().replace("É", "é") if i % 2 else rows[i][1]) for i in range(30)]
    rows += [(300 + i, "the same text again") for i in range(90)]
    rows += [(400, None), (401, ""), (402, " "), (403, "É"), (404, "é"), (405, "x" * 400_000 + " tail"), (406, "X" * 400_000 + " Tail"), (None, "the same text again"), (None, "of nobody"), (None, "Of nobody")]
    return rows + [rows[3], rows[3], (5, "another text of an id")]


def awkward(spark, rows, parts=6):
    more = [(*r, "en", "row", "sha", 1, 2, 3, 4) for r in rows]
    return spark.createDataFrame(more, AWKWARD).repartition(parts)


@pytest.mark.parametrize("width,n", [(8, 0), (8, 1), (8, 200), (20, 1000), (62, 500), (6, 64)])
def test_golomb_codes_come_back(width, n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64))
    shift = exact_dedup.golomb_shift(len(values), width)
    unary, low = exact_dedup.golomb_encode(values, shift)
    assert np.array_equal(exact_dedup.golomb_decode(unary, low, len(values), shift), values)
    if n >= 200:
        assert 8 * (len(unary) + len(low)) <= (max(0, width - math.log2(len(values))) + 3) * len(values) + 16


def test_exact_duplicates(spark, texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[lowered(t)].append(i)
    want = collections.Counter()
    for i, t in texts:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        want[(i, keep, len(groups[lowered(t)]), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest())] += 1
    got = exact_dedup.exact_duplicates(awkward(spark, texts))
    assert collections.Counter((r.row.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    assert {r.row.lang for r in got.collect()} == {"en"}


def test_exact_duplicates_of_no_rows(spark):
    assert exact_dedup.exact_duplicates(awkward(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[1:4] for r in exact_dedup.exact_duplicates(awkward(spark, [(1, None)])).collect()] == [(1, 1, True)]


def test_few_texts_are_shuffled(spark):
    """Only documents that share a fingerprint, and about one in 2^SLACK of the others."""
    d = spark.range(20_000).select(F.col("id").alias("doc"), F.xxhash64(F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.floor(F.col("id") / 100)).otherwise(F.col("id"))).alias("print"))
    found = {r.doc for r in exact_dedup.suspects(d.repartition(7)).distinct().collect()}
    prints = {r.doc: r.print for r in d.collect()}
    times = collections.Counter(prints.values())
    same = {i for i, p in prints.items() if times[p] > 1}
    assert same <= found and len(found - same) < 20_000 >> (exact_dedup.SLACK - 2)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made_words(seed, n, letters="abñ", lengths=(1, 2, 3, 5, 6, 9)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n)})


@pytest.mark.parametrize("limit", [1, 4, 1 << 16])
def test_near_words(spark, limit):
    """All pairs of a dense vocabulary, also where every partition is divided down to
    single edits; runs of one letter have many alignments."""
    words = made_words(1, 250) + ["aaaaaaa", "aaaaaa", "aaaaaaab"]
    if limit > 4:
        words += ["z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1499]
    rng = random.Random(2)
    d = spark.createDataFrame([(w, rng.randrange(3, 40)) for w in words], "word string, n long").repartition(3)
    n = {r.word: r.n for r in d.collect()}
    got = [tuple(r) for r in spelling.near_words(d, limit).collect()]
    assert all(n[a] == a_n and n[b] == b_n for a, a_n, b, b_n in got)
    pairs = [frozenset((a, b)) for a, _, b, _ in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}


def test_acceptor_is_minimal_and_numbers_words():
    words = made_words(3, 400)
    a = spelling.Acceptor(words)
    tails = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(a.final) == len(tails)  # a state for each different set of rests
    for i, w in enumerate(words):
        state, rank = a.start, 0
        for c in w:
            state, before = next((to, n) for x, to, n in a.arcs[state] if x == c)
            rank += before
        assert a.final[state] and rank == i


def brute_vocabulary(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_spelling_variants(spark):
    rng = random.Random(6)
    base = made_words(7, 60, "abcdeé", (5, 6, 7))
    base += [w[:i] + "x" + w[i:] for w in base[:20] for i in (0, 3)] + [w[:2] + w[3:] for w in base[:20]]
    weights = [1 / (1 + i % 17) ** 2 for i in range(len(base))]
    rows = [(i, " ".join(rng.choices(base, weights, k=60)).replace("a", "A" if i % 3 else "a")) for i in range(60)]
    rows += [(None, " ".join(base[:9])), (100, None), (101, ""), (102, "abcde " * 3000 + "y" * 70_000), (102, "abcde-ABCDE_abc×de ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ Ÿÿÿÿÿ")]
    d = awkward(spark, rows)
    n = brute_vocabulary(rows)
    assert {r.word: r.n for r in spelling.vocabulary(d).collect()} == n
    near = {w: sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: next((v for v in near[w][:1] if n[v] >= 2 * n[w]), None) for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    want = {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}
    assert {tuple(r) for r in spelling.spelling_variants(spelling.vocabulary(d)).collect()} == want
    assert any(form[w] and form[form[w]] for w in n)
    assert spelling.spelling_variants(spelling.vocabulary(d.limit(0))).count() == 0


def test_a_long_chain_of_forms(spark):
    words = [("a" * i + "bcdef", 2**i) for i in range(40)]
    got = spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.root for r in got} == {words[-1][0]} and sum(r.form is None for r in got) == 1


def brute_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, collections.Counter(term.findall(lowered(t)))) for i, t in docs if i is not None]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in set(items):
        if i is not None:
            asked[i].update(term.findall(lowered(t)))
    out = {}
    for i, q in asked.items():
        scores = []
        for d, c, n in held:
            m = 25 + (75 * n * big_n) // big_l
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scores.append((-s, d))
        out[i] = [(r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return {i: x for i, x in out.items() if x}


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, texts, monkeypatch, small):
    """Ties, copies, repeated ids, a hot stratum; with many parts, blocks and slices."""
    if small:
        for name, value in {"PART_TERMS": 60, "PART_DOCS": 4, "BLOCK_ITEMS": 3, "BLOCK_TERMS": 40, "SLICE_TERMS": 9, "FIRST": 1}.items():
            monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice([t for _, t in texts if t and len(t) < 1000]).split()[:40])) for i in range(8)]
    items += [(20, "The SAME text again!"), (21, "unknown terms only"), (22, None), (23, ""), (None, "w1é"), (24, "w1é w1é w1é w2é"), (24, "w1é w1é w1é w2é"), (25, "w3é"), (25, "w4é STRASSE straße"), (26, "é")]
    docs = spark.createDataFrame([(*t, "en", 1) for t in texts], "doc_id long, text string, item string, m long").repartition(5)
    got = collections.defaultdict(list)
    asked = spark.createDataFrame([(*t, 1) for t in items], "item_id long, text string, rank int")
    for r in sorted(lexical_search.search(docs, asked).collect(), key=lambda r: (r.item_id, r["rank"])):
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    assert dict(got) == brute_search(texts, items)


def test_search_of_no_rows(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1é")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_an_index_serves_many_searches(spark, texts):
    index = lexical_search.Index(spark.createDataFrame(texts, "doc_id long, text string"))
    one, two = (spark.createDataFrame([(1, t)], "item_id long, text string") for t in ("w5é w6é", "w7é"))
    for items, t in ((one, "w5é w6é"), (two, "w7é")):
        assert [(r["rank"], r.doc_id, r.score) for r in index.search(items, k=3).orderBy("rank").collect()] == brute_search(texts, [(1, t)], 3)[1]
