"""Exact groups and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldcheck.llm import exact, jaccard
from fieldcheck.llm.common import only

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, rep string, n int")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is not None, i or 0))
    out = []
    for i, t in rows:
        norm = SPACE.sub("", t or "")
        best = min(groups[norm])
        out.append((i, best[2] if best[1] else None, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_edges(spark):
    long = "ab" * 40000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab "), (6, " a  b"), (7, long), (8, long + "x"), (9, "\t" + long),
            (10, long[:64]), (11, long[:64]), (12, long[:576]), (13, "é é"), (14, "éé"), (4, "a b"), (None, "zz"), (15, "z z ")]
    out = exact.exact_groups(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str) == brute_exact(rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact.exact_groups(frame(spark, rows).limit(0)).count() == 0


def test_split_many():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 63, 64, 65, 576, 600)))) for _ in range(60)]
    texts += [t + b"a" for t in texts[:20]] + texts[:30]
    got = sorted(sorted(g) for g in exact.split(texts, list(range(len(texts)))))
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert got == sorted(want.values())


def sets_of(rows, k):
    out = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute_near(rows, k, percent):
    sets = sets_of(rows, k)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append((d is not None, d or 0))
    best = {r: min(m)[1] if min(m)[0] else None for r, m in comp.items()}
    return sorted([(d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def planted(seed, n_groups, group):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, line = [], [rng.choice(words) for _ in range(30)]
    for g in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.choice((8, 40, 90)))]
        if g % 2:
            base += line
        for _ in range(group):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice(([], [rng.choice(words)], [own[at], rng.choice(words)]))
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent, share, long, short", [(4, 85, 20_000, 20_000, 16), (5, 80, 7, 20_000, 2), (3, 60, 20_000, 5, 4)])
def test_near_planted(spark, monkeypatch, k, percent, share, long, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "SHARE", share)
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = planted(percent, 12, 14)
    rows += [(1000, None), (1001, " "), (1002, "a b"), (1003, "A  b"), (1004, "b a"), (None, rows[0][1]), (1005, rows[3][1] + "  "),
             (rows[5][0], rows[5][1]), (1006, "tail " * 30000)]
    out = jaccard.near_groups(frame(spark, rows), k, percent).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute_near(rows, k, percent)


def test_near_copies_of_hot_texts(spark, monkeypatch):
    """A text with more copies than a task's share still links with its one near copy."""
    monkeypatch.setattr(jaccard, "SHARE", 2)
    monkeypatch.setattr(jaccard, "parts", lambda docs: 200)
    rows = []
    for g in range(6):
        base = [f"t{g}w{i}" for i in range(40)]
        rows += [(len(rows) + i, " ".join(base)) for i in range(60)]
        rows.append((len(rows), " ".join([*base, "more"])))
    out = jaccard.near_groups(frame(spark, rows).coalesce(2), 5, 80).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute_near(rows, 5, 80)


def test_one_of_repeated_rows(spark):
    """Which of the rows with one doc_id and text stays does not depend on how they are dealt."""
    rows = [(d, t, x, {"k": x}) for d, t in ((1, "a b"), (None, "a b"), (2, None)) for x in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest int, m map<string,int>")
    kept = df.select("doc_id", F.xxhash64("text").alias("th"))
    got = [sorted(((r.doc_id, r.text, r.rest) for r in only(df.repartition(n).orderBy(F.rand(n)), kept).collect()), key=str) for n in (1, 3, 5)]
    assert len(got[0]) == 3 and got[0] == got[1] == got[2]
    assert only(df.select("doc_id", "text"), kept).count() == 3


def test_near_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = jaccard.near_groups(spark.read.parquet(f"{SF}/documents.parquet"), 4, 85).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute_near(rows, 4, 85)
    assert jaccard.near_groups(frame(spark, rows).limit(0)).count() == 0


def test_all_pairs_of_lists():
    """Every pair of sets that links and has different labels is among the candidates of some list."""
    rng = np.random.default_rng(5)
    t = jaccard.Threshold(70)
    sets = []
    for _ in range(40):
        base = rng.choice(4000, 60, replace=False)
        for _ in range(3):
            s = base.copy()
            s[:rng.integers(0, 14)] = rng.integers(4000, 9000)
            sets.append(np.unique(s))
    e = []
    for i, s in enumerate(sets):
        m = int(t.prefix(len(s)))
        e += [(int(g), i, len(s), p) for p, g in enumerate(s[:m])]
    e = np.array(sorted(e, key=lambda x: (x[0], x[2], x[3])), jaccard.ENTRY)
    got = {tuple(map(int, p)) for p in jaccard.pairs_of(e, e["sid"].astype(np.int64), t, True)}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if t.links(both, len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got


def test_marks_in_a_task(monkeypatch):
    """The marks of a task count what two sets share at least; few bits at once change nothing."""
    rng = np.random.default_rng(9)
    own = [rng.integers(0, 300, rng.integers(0, 40)).astype("<u2") for _ in range(30)]
    sids = rng.permutation(30).astype(np.uint64)
    x, y = rng.integers(0, 30, (2, 200))
    for at_once in (1, 1 << 20):
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
        m = jaccard.Marks(sids, pa.chunked_array([pa.array([o.tobytes() for o in own], pa.binary())]))
        by_sid = [own[i] for i in np.argsort(sids)]
        got = m.shared(x, y, np.zeros(200, np.int64))
        for i, j, n in zip(x, y, got):
            a, b = sorted((by_sid[i], by_sid[j]), key=len)
            assert n == sum(v in set(b.tolist()) for v in a.tolist()) or len(a) == len(b)
    assert len(jaccard.Marks(np.zeros(0, np.uint64), pa.chunked_array([], pa.binary())).sids) == 0


def test_a_pair_leaves_one_list():
    """Of all the lists in which two sets meet, that of their first common gram alone gives the pair."""
    rng = np.random.default_rng(9)
    own = [np.sort(rng.choice(40, rng.integers(1, 20), replace=False)).astype(np.uint64) + np.uint64(1 << 63) for _ in range(12)]
    x, y = np.triu_indices(len(own), 1)
    times = np.zeros(len(x), int)
    for g in np.unique(np.concatenate(own)):
        some = [k for k in range(len(x)) if g in own[x[k]] and g in own[y[k]]]
        times[some] += jaccard.first_met(np.full(len(some), g), x[some], y[some], own)
    assert times.tolist() == [int(len(np.intersect1d(own[a], own[b])) > 0) for a, b in zip(x, y)] and times.any()


def test_forest():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 200):
        a, b, w = rng.integers(0, 25, n), rng.integers(30, 60, n), rng.integers(0, 5, n)
        got = jaccard.forest(a, b, w)
        parent = list(range(60))

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        best = 0
        for i in sorted(range(n), key=lambda i: -w[i]):
            p, q = find(int(a[i])), find(int(b[i]))
            if p != q:
                parent[p] = q
                best += int(w[i])
        whole = [find(v) for v in range(60)]
        parent = list(range(60))
        for i in got.tolist():
            p, q = find(int(a[i])), find(int(b[i]))
            assert p != q
            parent[p] = q
        assert int(w[got].sum()) == best
        assert len({(x, find(v)) for v, x in enumerate(whole)}) == len(set(whole))


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    """2,000 unlike texts with one passage: its lists hold them all, and hardly a pair leaves a task."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([passage, *(f"v{rng.randrange(100000)}" for _ in range(16))])) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(0, 40, 2)]
    seen = []
    real = jaccard.NearJoin._verify

    def counted(self, pairs):
        seen.append(pairs.count())
        return real(self, pairs)

    monkeypatch.setattr(jaccard.NearJoin, "_verify", counted)
    out = jaccard.near_groups(frame(spark, rows), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in out if r.component_id != r.doc_id} == {5000 + i: i for i in range(0, 40, 2)}
    assert sum(seen) < 6000


def test_driver_holds_no_table_of_counts(spark):
    """What steers the join comes to the driver packed: whole tables of counts took over 100 MB there."""
    import tracemalloc

    rows = [(i, f"{i} one {i % 7} two three four") for i in range(300)] + [(400 + i, "the same five words here again") for i in range(50)]
    tracemalloc.start()
    try:
        join = jaccard.NearJoin(frame(spark, rows), 5, jaccard.Threshold(80))
        groups = {r.rid: r.component_rid for r in join.groups().collect()}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6
    assert len(set(groups.values())) == 301


def test_levels_of_pieces():
    """Packed pieces hold what the whole table gives; a piece that is missing has ordinary slots."""
    counts = np.random.default_rng(3).poisson(3, jaccard.SLOTS)
    counts[5::9973] = 70_000
    counts[:jaccard.SLOTS // jaccard.PIECES] = 0
    mean = counts.mean()
    pieces = [(p, *(jaccard.zlib.compress(y.tobytes()) for y in (jaccard.levels(x, mean), (x // jaccard.SHARE + 1).astype("<u2"))))
              for p, x in enumerate(np.split(counts, jaccard.PIECES)) if p]
    level, split = jaccard.unpacked(pieces)
    assert (level == jaccard.levels(counts, mean)).all() and (split == counts // jaccard.SHARE + 1).all() and split.max() == 4


def test_shared_marks_bound():
    """Linked sets always share as many of their first grams as the filter asks for."""
    rng = np.random.default_rng(6)
    t = jaccard.Threshold(80)
    for _ in range(300):
        base = rng.choice(10**6, rng.integers(1, 200), replace=False)
        cut = rng.integers(0, len(base) // 8 + 1)
        x, y = np.sort(base), np.sort(np.concatenate([base[cut:], rng.choice(10**6, rng.integers(0, 12)) + 10**6]))
        if rng.random() < 0.5:
            x, y = 2 * 10**6 - x[::-1], 2 * 10**6 - y[::-1]
        both = len(np.intersect1d(x, y))
        if t.links(both, len(x) + len(y) - both):
            px, py = x[:t.prefix(len(x))], y[:t.prefix(len(y))]
            assert len(np.intersect1d(px, py)) >= t.shared(len(x), len(y))


@pytest.mark.parametrize("at_once", [20, 1 << 18])
def test_components(spark, monkeypatch, at_once):
    from fieldcheck.llm import common
    from fieldcheck.llm.common import components

    monkeypatch.setattr(common, "EDGES", at_once)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5), (7, 3)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    for n in (1, 7):
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(n)).collect()
        assert {r.node: r.label for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
