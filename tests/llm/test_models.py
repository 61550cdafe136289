"""Language models, language ID and the pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldcheck.llm import langid, lm
from fieldcheck.llm.queries import op2_lm_scores, op3_language_id, pipeline

SF = "/root/testdata/sf0.001"


def frame(spark, rows, kind="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, kind)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]


def check_scores(out, docs):
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    c = collections.Counter(x for d, t in docs if crc(d) != 1 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted([(str(d), crc(d) == 1, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                    round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for d, t in docs])
    got = sorted([(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out])
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-5) for a, b in zip(got, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_lm_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = op2_lm_scores(spark, SF).collect()
    check_scores(out, docs)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges(spark):
    docs = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "b"), (9, "x " * 40000)]
    df = frame(spark, [(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double")
    check_scores(lm.scores(df).collect(), docs)
    assert lm.scores(df.limit(0)).count() == 0
    only_held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1][:3]
    out = lm.scores(frame(spark, [(d, "a b", 1.0) for d in only_held], "doc_id long, text string, score double")).collect()
    assert len(out) == 3 and all(r.n_known == 0 and r.train_tokens == 0 for r in out)


def test_seating_and_predictive():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 400, (6, lm.CLASSES)) * (rng.random((6, lm.CLASSES)) < 0.2)
    parent = rng.dirichlet(np.ones(lm.CLASSES))
    t = lm.seat(c, parent, np.minimum(c, 1).astype(float), 0.8, 50.0, rng)
    assert ((t >= (c > 0)) & (t <= c)).all() and (t > 1).any()
    p = lm.predictive(c, t, parent, 0.8, 50.0)
    assert np.allclose(p.sum(1), 1)
    # Drawing customers singly and by jumps gives about the same number of tables.
    many = []
    for limit in (0, 10**6):
        old, lm.ONE_BY_ONE = lm.ONE_BY_ONE, limit
        many.append(np.mean([lm.seat(c, parent, np.minimum(c, 1).astype(float), 0.8, 50.0, rng).sum() for _ in range(3)]))
        lm.ONE_BY_ONE = old
    assert abs(many[0] - many[1]) < 0.15 * many[1]


def ways(d, most=6):
    """Weights of c customers at k tables, by enumerating all set partitions."""
    out = np.zeros((most + 1, most + 1))

    def seated(sizes, left, w):
        c = sum(sizes)
        if c:
            out[c, len(sizes)] += w
        if left:
            for i, n in enumerate(sizes):
                seated(sizes[:i] + [n + 1] + sizes[i + 1:], left - 1, w * (n - d))
            seated(sizes + [1], left - 1, w)

    seated([], most, 1.0)
    return out


@pytest.mark.parametrize("d", [0.5, 0.8])
def test_seating_against_enumeration(d):
    """Sweeps over six customers of one dish, in a restaurant with strength 50, keep the exact law of the tables."""
    rng, theta, h, n = np.random.default_rng(3), 50.0, 0.01, 20000
    s = ways(d)
    want = np.array([s[6, k] * h ** k * np.prod(theta + d * np.arange(k)) for k in range(7)])
    for limit in (0, 64):
        old, lm.ONE_BY_ONE = lm.ONE_BY_ONE, limit
        t = np.ones((n, 1))
        for _ in range(4):
            t = lm.seat(np.full((n, 1), 6), np.array([h]), t, d, theta, rng)
        lm.ONE_BY_ONE = old
        assert np.abs(np.bincount(t[:, 0].astype(int), minlength=7) / n - want / want.sum()).max() < 0.02


def test_tables_of_large_counts():
    """The window about the mode against the whole law, written out."""
    rng = np.random.default_rng(4)
    logs = lm._log_ways(400, 0.5)
    for c, y in ((400, 0.01), (400, 3.0), (400, 1e4), (65, 50.0)):
        k = np.arange(1, c + 1)
        p = logs[c, 1:c + 1] + k * math.log(y)
        p = np.exp(p - p.max())
        p /= p.sum()
        got = lm.tables(np.full(20000, c), np.full(20000, y), rng)
        assert abs(got.mean() - p @ k) < 5 * got.std() / 20000 ** 0.5 + 1e-3 and abs(got.std() - (p @ k ** 2 - (p @ k) ** 2) ** 0.5) < 0.05 * got.std() + 1e-3
    many = lm.tables(np.array([10**9, 10**9]), np.array([1e-6, 1e3]), rng)
    # For c beyond all y the tables are 1 + Poisson(2 y).
    assert many[0] == 1 and 1700 < many[1] < 2300


def test_parent_against_enumeration():
    """Tables and mean probabilities of the parent with two words of 3 and 2 customers, by sweeps and by enumeration."""
    rng, theta, c = np.random.default_rng(5), lm.STRENGTH[0], np.array([3, 2, 0])
    s = ways(0.5)
    want = {(a, b): s[3, a] * s[2, b] * 3.0 ** -(a + b) * np.prod(theta + 0.5 * np.arange(a + b)) for a in (1, 2, 3) for b in (1, 2)}
    all_ = sum(want.values())
    mean = sum(x * lm.predictive(c[None], np.array([[a, b, 0]]), np.full(3, 1 / 3), 0.5, theta)[0] for (a, b), x in want.items()) / all_
    zeta, scale, got, p, n = 2 * theta, theta, collections.Counter(), np.zeros(3), 20000
    for _ in range(n):
        t, g = lm.masses(c, zeta / 3, rng.gamma(5) / scale, rng)
        scale = g.sum()
        zeta = lm.process_time(2, (1 / g).sum(), rng)
        got[tuple(t[:2].tolist())] += 1 / n
        p += g / scale / n
    assert all(abs(got[x] - want[x] / all_) < 0.03 for x in want)
    assert np.abs(p - mean).max() < 0.01


def test_words_are_contexts(spark):
    """Words that share the upper bits of their hashes have restaurants of their own, also where contexts are split."""
    from fieldcheck.llm.common import SPACED, words

    names = [f"w{i}" for i in range(20000)]
    k = words(pa.array([" ".join(names)]), SPACED).hashes() >> np.uint64(54)
    u1, u2, x, y = (names[i] for i in np.flatnonzero(k == k[0])[:4])
    train = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 != 1]
    held = [d for d in range(400, 900) if zlib.crc32(str(d).encode()) % 5 == 1]
    rows = [(d, f"{u1} {x}" if i % 2 else f"{u2} {y}") for i, d in enumerate(train)] + [(held[0], f"{u1} {x}"), (held[1], f"{u1} {y}"), (held[2], f"{u2} {y}")]
    df = frame(spark, rows, "doc_id long, text string")
    old, lm.HOT = lm.HOT, 20
    try:
        got = {r.doc_id: r.score for r in lm.scores(df).collect()}
    finally:
        lm.HOT = old
    same = {r.doc_id: r.score for r in lm.scores(df).collect()}
    assert all(abs(got[d] - same[d]) < 0.1 for d in got)
    assert got[held[0]] - got[held[1]] > 1 and abs(got[held[0]] - got[held[2]]) < 0.1


def test_word_probabilities_sum_to_one(spark):
    """After every context, the probabilities of all words and of the unknown one."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{min(int(i), 60)}" for i in rng.zipf(1.3, 40)) for _ in range(60)]
    plain = frame(spark, [(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    rows = lm.stored(lm._map(plain, lm._read, lm._BATCH), "batches")
    lexicon = lm._lexicon(rows, 3)
    v = lexicon.agg(F.sum("v")).first()[0]
    assert v == len({w for t in texts for w in t.split()}) + 1
    pieces = lm._pieces(rows, np.zeros(0, np.uint64), 3)
    sent, back, parent = lm.gibbs(lexicon, pieces, 3, v)
    c, left, weight = collections.Counter(), collections.Counter(), {}
    total = np.array([(lm.STRENGTH[0] + lm.DISCOUNT * t) / (lm.STRENGTH[0] + n) for n, t in parent])  # uniform over v + 1
    known = {r.part: lm._open(bytes(r.known), "<f4") for r in sent.where("piece IS NULL").collect()}
    for r in lexicon.where("batch IS NULL").collect():
        h, k = np.frombuffer(bytes(r.words), np.uint64).tolist(), known[r.part].reshape(lm.SAMPLES, 2, -1)
        c.update(dict(zip(h, np.frombuffer(bytes(r.counts), "<i8").tolist())))
        weight |= dict(zip(h, k[:, 1].T))
        total += k[:, 0].sum(1) / [lm.STRENGTH[0] + n for n, _ in parent]
    assert np.allclose(total, 1, atol=1e-5)
    drawn = {r.piece: lm._open(bytes(r.drawn), "<i8") for r in back.where("part IS NULL").collect()}
    lists = collections.defaultdict(list)
    for r in pieces.where("kind = 2").orderBy("part").collect():
        lists[r.piece] += np.frombuffer(bytes(r.a), np.uint64).tolist()
    for r in pieces.where("kind = 1").collect():
        h = np.array(lists[r.piece], np.uint64)[lm._open(bytes(r.a), "<u2")]
        n, t = lm._open(bytes(r.c), "<i8"), drawn[r.piece]
        assert (t >= lm.SAMPLES).all() and (t <= n * lm.SAMPLES).all()
        for u, x in zip(h.tolist(), (n - lm.DISCOUNT * t / lm.SAMPLES).tolist()):
            left[u] += x
    for r in pieces.where("kind = 2").collect():
        for u, x in zip(np.frombuffer(bytes(r.c), np.uint64).tolist(), lm._open(bytes(r.d), "<u4").tolist()):
            left[u] += x * (1 - lm.DISCOUNT)
    assert len(c) == v and all(abs(left[u] / (lm.STRENGTH[1] + c[u]) + weight[u] @ total / lm.SAMPLES - 1) < 1e-4 for u in c)


def test_large_moves_go_in_turns(spark, monkeypatch):
    """Pairs are counted, and batches scored, share by share; the shares are all of them."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{min(int(i), 60)}" for i in rng.zipf(1.3, 30)) for _ in range(80)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(24)
    moved, store = {}, lm.stored_together

    def spy(name, *tables):
        shares = moved[name] = [t.collect() for t in tables]
        assert len(shares) == lm.TURNS
        return store(name, *tables)

    monkeypatch.setattr(lm, "stored_together", spy)
    got = {r.doc_id: r.score for r in lm.scores(df).collect()}
    assert set(moved) == {"pieces", "scores"} and set(got) == set(range(80))
    for i, rows in enumerate(moved["pieces"]):
        assert rows and all(r.piece % lm.TURNS == i for r in rows)
    shares = [{r.doc_id for r in rows} for rows in moved["scores"]]
    assert sum(map(len, shares)) == 80 and set().union(*shares) == set(range(80)) and max(map(len, shares)) < 60


def test_batches_are_packed():
    """Codes and hashes come back as they were, in fewer bits than whole numbers of their ranges take."""
    rng = np.random.default_rng(9)
    for n, most in ((1, 1), (9, 3), (300000, 70000)):
        h = np.append(np.sort(rng.choice(1 << 62, most - 1, replace=False)).astype(np.uint64), lm.END)
        code = rng.permutation(most)[np.minimum(rng.zipf(1.2, n) - 1, most - 1)].astype(np.uint32)
        for counts in (np.bincount(code, minlength=most).astype("<u4"), np.zeros(most, "<u4")):
            packed = lm._pack_codes(code, counts)
            assert (lm._open_codes(packed, n, counts) == code).all()
            if n > 9 and counts.any():
                assert 8 * len(packed) < 0.75 * n * math.log2(most) and len(packed) < 0.8 * len(lm._pack(code))
        assert (lm._open_sorted(lm._pack_sorted(h)) == h).all()
        assert most < 9 or len(lm._pack_sorted(h)) < 7 * most


def test_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(2)
    net = langid.ByteGRU(["a", "b"])
    for p in (net.embed, net.out, net.bias):
        p[...] = p.astype(np.float32)
    x = rng.integers(97, 100, (5, 3))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])
    x = np.where(mask, x, 0)
    target, weight = np.array([[0.2, 0.8], [1, 0], [0.5, 0.5]], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        share = mask * weight
        logs = net.position_logs(x, mask)
        return float(-(share[:, :, None] * target * logs).sum() / share.sum())

    for p, g in list(net._gradients(x, mask, target, weight)):
        for i in rng.choice(p.size, min(6, p.size), replace=False):
            old, eps = p.flat[i], 1e-2
            p.flat[i] = old + eps
            up = loss()
            p.flat[i] = old - eps
            down = loss()
            p.flat[i] = old
            assert abs((up - down) / (2 * eps) - g.flat[i]) < 2e-3


@pytest.fixture(scope="module")
def predicted(spark):
    return op3_language_id(spark, "/root/testdata/sf0.01").collect()


def test_language_accuracy(spark, predicted):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in predicted if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in predicted)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in predicted) and len(predicted) == len(truth)


def test_language_edges(spark):
    train = [(i, t, g, "s", 1) for i in range(40) for t, g in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    rows = train + [(100, None, None, "s", 1), (101, "12 34 !!", "en", "s", 1), (102, "", "de", "s", 1), (103, "the dog", None, "s", 1),
                    (103, "the dog", "en", "s", 1), (None, "die katze " * 20000, None, "s", 1)]
    df = frame(spark, rows)
    model = langid.fitted(langid.labelled(df))
    out = langid.languages(df, model).where("doc_id >= 100 OR doc_id IS NULL").collect()
    got = collections.defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[100] == got[101] == got[102] == [("und", 0.0)]
    assert got[103][0] == got[103][1] and got[103][0][0] == "en" and got[None][0][0] == "de"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.where("doc_id IN (100, 101, 102)").count() == 0
    none = frame(spark, [(1, "abc", None, "s", 1)])
    assert langid.fitted(none) is None and langid.languages(none, None).first().lang_pred == "und"
    assert sorted(r.doc_id for r in langid.keep_known(df, None).collect() if r.doc_id and r.doc_id >= 100) == [103, 103]
    assert langid.languages(df.limit(0), model).count() == 0


def test_sample_of_copies(spark):
    """Copies take no places in the sample, and a language of few texts in many rows is learned."""
    rows = [(i, f"text {g} {i % d}", g, "s", 1) for g, d, n in (("aa", 5, 4000), ("bb", 30, 3000), ("cc", 3, 3), ("dd", 900, 1000)) for i in range(n)]
    rows += [(i, "one text", "dd", "s", 1) for i in range(2000)]
    df = frame(spark, rows)
    for most in (20, 400):
        got = collections.Counter(langid.sample(df.select("lang", "text"), most).collect())
        assert max(got.values()) == 1
        n = collections.Counter(r.lang for r in got)
        assert n == {"aa": 5, "bb": min(30, most), "cc": 3, "dd": most}
        hashes = {g: sorted({r.h for r in df.where(F.col("lang") == g).select(F.xxhash64("text").alias("h")).collect()}) for g in n}
        chosen = df.sparkSession.createDataFrame([tuple(r) for r in got], "lang string, text string").select("lang", F.xxhash64("text").alias("h")).collect()
        assert all(sorted(r.h for r in chosen if r.lang == g) == hashes[g][:most] for g in n)


def test_predictions_remembered():
    model = langid.train(["aa bb", "cc dd"] * 5, ["x", "y"] * 5)
    text = pa.array(["aa cc", "bb " * 9, "dd"])
    once, again = langid.Pooler(model), langid.Pooler(model)
    again(pa.array(["bb dd", "aa"]))
    assert np.allclose(once(text)[0], again(text)[0])


def test_pipeline_stages(spark, tmp_path):
    """Each stage against plain code on its own input."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()[:250]
    rows = [tuple(r) for r in base] + [(5000, None, "en", "s", 0), (5001, "..", "en", "s", 2), (5002, base[3].text + " ", "en", "s", 9),
                                       tuple(base[4]), (None, base[6].text, "en", "s", 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(re.findall(r"\w+", base[10].text)[:15])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, before = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        now = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in now} == {5000, 5001}
        elif name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in now]
            assert len(set(norm)) == len(norm) and set(norm) == {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in before}
            assert 5002 in {r.doc_id for r in now} and None in {r.doc_id for r in now}
        elif name == "near_dedup":
            from tests.llm.test_groups import brute_near
            want = brute_near([(r.doc_id, r.text) for r in before], 5, 80)
            assert {r.doc_id for r in now} == {c for _, _, c in want}
        elif name == "decontamination":
            assert 10 not in {r.doc_id for r in now} and len(before) - len(now) <= 2
        else:
            assert [(r.doc_id, r.text) for r in now] == [(r.doc_id, r.text) for r in before] and all(r.token_ids for r in now)


def test_pipeline_runs_again(spark):
    one, two = ({tuple(map(str, r)) for r in pipeline(spark, SF).collect()} for _ in range(2))
    assert one == two
