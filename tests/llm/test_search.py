"""Divergence of sources and ranked search against plain code."""

import math
import random
import re

import numpy as np
import pytest

from fieldcheck.llm import divergence, ranking

LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least=10, top=10):
    docs = [(lang or "", source or "", LETTER.findall((text or "").translate(AZ))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        kept = sorted(t for t in {t for x in own for t in x[2]} if sum(t in x[2] for x in own) >= least)
        sources = sorted({x[1] for x in own})
        counts = {s: {t: sum(x[2].count(t) for x in own if x[1] == s) for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        total = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s, c in counts.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:most])]
    return sorted(out)


def corpus(n, seed, words=40):
    rng = random.Random(seed)
    vocabulary = [f"{c}{'Éa☂é'[i % 4]}{'x' * (i // 20)}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 3)][:words]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary[:rng.randint(3, words)], k=rng.randint(0, 30))) + rng.choice(["", " 12 a1b", "\x00Z"])
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "S", "é", None])))
    return rows + [("only here", "xx", "lone"), ("other", "xx", "s1"), (None, "yy", "s1")] + [("same same", "zz", "a")] * 12 + [("", "zz", "b")]


def test_divergence(spark):
    rows = corpus(400, 1)
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1L AS n", "'q' AS term", "0 AS value")
    got = sorted(map(tuple, divergence.source_divergence(df.repartition(7)).collect()))
    assert got == brute_divergence(rows)
    assert ("zz", "a", "pair", "b", 0, 1) in got and ("xx", "lone", "pair", "s1", 0, 1) in got


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(df).count() == 0


def test_accumulator_in_small_steps(monkeypatch):
    rng = np.random.default_rng(3)
    entries = sorted({(int(t), int(g)) for t, g in rng.integers(0, [30, 9], (150, 2))})
    term, group = np.array(entries).T
    p, zero = rng.integers(50, 10**9, len(term)), rng.integers(1, 50, 9)
    want = np.zeros((9, 9), np.int64)
    for i in range(len(term)):
        for j in range(len(term)):
            if term[i] == term[j] and group[i] < group[j]:
                a, b, y, z = int(p[i]), int(p[j]), int(zero[group[i]]), int(zero[group[j]])
                want[group[i], group[j]] += sum(s * ((u - v) ** 2 // (u + v)) for s, u, v in ((1, a, b), (-1, a, z), (-1, y, b), (1, y, z)))
    for step in (1, 5, 1 << 20):
        monkeypatch.setattr(divergence, "SCATTER", step)
        got = np.array([acc for _, acc in divergence.accumulate(group, term, p, zero[group], 9)])
        assert (got == want).all()


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 10**6)], "n long, t long, v long")
    assert df.select(divergence.share("n", "t", "v")).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2 * 10**6)


def brute_search(docs, items, k):
    words = [(i, ALNUM.findall((t or "").translate(AZ))) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(ALNUM.findall((t or "").translate(AZ)))
    df = {t: sum(t in w for _, w in words) for t in set().union(*asked.values())}
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in words:
            if w:
                m = 50 + 50 * len(w) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
                if s > 0:
                    scored.append((-s, i is not None, i or 0))
        out += [(item, r + 1, d if v else None, -s) for r, (s, v, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def search_docs(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É1", "Ab"]
    docs = [(rng.choice([i, i, 7, None]), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40])))) for i in range(n)]
    items = [(i // 2, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 12])))) for i in range(12)] + [(None, "w1 W2"), (99, "nowhere"), (98, None)]
    return docs + [(3, None), (4, ""), *docs[:20]], items


@pytest.mark.parametrize(("seed", "k"), [(1, 5), (2, 50)])
def test_search(spark, monkeypatch, seed, k):
    docs, items = search_docs(150, seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id int, text string, term string, score int").repartition(5)
    by = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    want = brute_search(docs, items, k)
    assert sorted(map(tuple, ranking.lexical_search(df, by, k).collect()), key=str) == want
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ranking, "CELLS", 30)
    assert sorted(map(tuple, ranking.lexical_search(df, by, k).collect()), key=str) == want


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    for d, i in ((docs, items), (docs.limit(0), items), (docs, items.limit(0))):
        out = ranking.lexical_search(d, i)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_nra_reads_in_small_runs():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, t, k = int(rng.integers(1, 40)), int(rng.integers(1, 6)), int(rng.integers(1, 8))
        score = rng.integers(0, 4, (t, n)) * (rng.random((t, n)) < 0.7)
        lists = [sorted(((-int(score[i, d]), d) for d in np.flatnonzero(score[i])), key=lambda x: (x[0], rng.random())) for i in range(t)]
        ends = np.cumsum([0, *map(len, lists)])
        doc = np.array([d for x in lists for _, d in x], np.int64)
        impact = np.array([-s for x in lists for s, _ in x], np.int64)
        total = score.sum(0)
        order = sorted((-int(s), d) for d, s in enumerate(total) if s)
        floor = int(rng.integers(0, 3))
        least = max(floor, -order[k - 1][0] if len(order) >= k else 1, 1)
        got = ranking.nra(doc, impact, ends[:-1].copy(), ends[1:], n, k, floor, run=1)
        assert sorted(zip((-got[1]).tolist(), got[0].tolist())) == [x for x in order if -x[0] >= least]


def test_length_factor_beyond_64_bits():
    n, docs, terms = np.array([0, 10**8, 3]), 10**12, 10**15
    assert ranking.length_factor(n, docs, terms).tolist() == [50 + 50 * int(x) * docs // terms for x in n]
