"""Personal data, licenses, contamination and substring removal against plain code."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldcheck.llm import decontam, licenses, pii, substring
from fieldcheck.llm.common import ALNUM, SPACED, span_hashes, words
from fieldcheck.llm.queries import op1_pii, op5_license_scan, op9_decontamination, op10_substring_dedup

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, spans string, n_words int")


def brute_pii(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        s = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0

    kinds = [("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15)]
    return [(k, *m.span()) for k, p, ok in kinds for m in p.finditer(t) if ok(m.group())]


PII = ["a.b@c-d.example.com, x@y a@b@c.de.f @x.y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 5",
       "+1 (415) 555-0100 +12 +1234567890123456 +4-4", "é 4111111111111111é a@b.c", "", None, "@" * 50, "9" * 500, "1." * 300, "a@" * 80 + "b.c",
       "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "card 3782 822463 10005 x 378282246310005 "]


def test_pii_long_digit_runs():
    for n in (4300, 4301, 10**6):
        run = "0" * n
        for t in (f"{run}.1.1.1", f"1.{run}.1.1", f"1.1.{run}.1", f"1.1.1.{run}", f"{run}.{run}.{run}.{run}"):
            assert base_of(t)[0] == ("ip", 0, len(t))
        assert base_of(f"{run}256.1.1.1") == [] and base_of("9" * n + ".1.1.1") == []
        assert base_of("+" + "9" * n) == base_of("4" * n) == [] and base_of("9" * n + "@b.c")[0] == ("email", 0, n + 4)


def base_of(t):
    return [(k, a, b) for k, a, b, _, own in pii.spans(t) if own]


def test_pii_cases():
    for t in [*PII, " ".join(filter(None, PII))]:
        assert base_of(t) == brute_pii(t), t
    added = [(k, "DE89 3704 0044 0532 0130 00") for k, a, b, _, own in pii.spans(PII[11]) if not own]
    assert added == [("iban", PII[11][5:32])]
    assert [s[0] for s in pii.spans(PII[12]) if not s[4]] == ["card15", "card15"]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab@@..%-+ 012459()\n"), max_size=60))
def test_pii_random(t):
    assert base_of(t) == brute_pii(t)


def test_pii_query(spark):
    rows = {r.doc_id: r for r in op1_pii(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, r = brute_pii(d.text), rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in ("email", "ip", "card", "phone")]
    df = frame(spark, [(1, None), (1, "mail a@b.co"), (None, "x" * 200000)])
    assert [r.n_email for r in pii.personal_data(df).orderBy("n_email").collect()] == [0, 0, 1]
    assert [r.text for r in pii.redact(df).where("doc_id = 1").collect()] == [None, "mail <email>"]
    assert pii.personal_data(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1Z é語-'\n\t\x0b"), max_size=20), max_size=5))
def test_words(texts):
    for table, lower, pattern in ((SPACED, False, r"[^\x20\x09-\x0D]+"), (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(pa.array(texts, pa.string()), table, lower)
        want = [re.findall(pattern, "".join(c.lower() if c.isascii() and lower else c for c in t)) for t in texts]
        assert [[w.text(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])] == want
        h = w.hashes()
        flat = [x for t in want for x in t]
        assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_long_word_hashes():
    data = np.frombuffer(b"abcdefgh" * 20 + b"x" + bytes(8), np.uint8)
    h = span_hashes(data, np.array([0, 8, 0, 0, 1]), np.array([8, 16, 16, 160, 161]))
    assert h[0] == h[1] and len(set(h.tolist())) == 4


def brute_contamination(docs, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    tests = [(i, split(t)) for i, t in items]
    out = []
    for d, t in docs:
        w = split(t)
        hit, met = set(), set()
        for i, x in tests:
            m = min(n, len(x))
            grams = {tuple(x[k:k + m]) for k in range(len(x) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if m and tuple(w[k:k + m]) in grams:
                    hit.update(range(k, k + m))
                    met.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaks():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x-y"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 3, 9, 10, 14))))) for i in range(20)]
    items += [(20, None), (21, " . "), (5, "w1 w2 w3 w4"), (None, "w9 w8 w7")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(30)]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(30)
            w[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((d, rng.choice((" ", ", ", "\n")).join(w)))
    return docs + [(100, None), (101, ""), (3, docs[3][1]), (None, docs[0][1])], items


def test_contamination(spark, monkeypatch):
    docs, items = leaks()
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    out = decontam.contamination(df, bench)
    assert sorted([tuple(r)[:6] for r in out.collect()], key=str) == want
    clean = decontam.decontaminate(df, bench).collect()
    assert sorted([(r.doc_id, r.text) for r in clean], key=str) == sorted(
        [d for d in docs if not brute_contamination([d], items)[0][5]], key=str)
    cut = decontam.decontaminate(df, bench, remove="spans")
    assert cut.columns == df.columns and cut.count() == len(docs)
    spans = sorted(map(tuple, cut.collect()), key=str)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 10)
    # Beyond the bound of the broadcast the rows are the same, whatever their columns are called.
    wide = df.selectExpr("*", "doc_id AS rid", "'x' AS at", "text AS item", "1 AS size")
    for how, same in (("documents", sorted(map(tuple, clean), key=str)), ("spans", spans)):
        far = decontam.decontaminate(wide, bench, remove=how)
        assert far.columns == wide.columns
        assert sorted([tuple(r)[:len(df.columns)] for r in far.collect()], key=str) == same
        assert decontam.decontaminate(wide.limit(0), bench, remove=how).count() == 0
    assert sorted([tuple(r)[:6] for r in decontam.contamination(df, bench).collect()], key=str) == want
    assert decontam.contamination(df.limit(0), bench).count() == 0
    monkeypatch.undo()
    assert decontam.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted([tuple(r) for r in op9_decontamination(spark, SF).collect()], key=str) == brute_contamination(docs, items)


def brute_substring(docs, window):
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs}, key=lambda x: x[:2])
    seen, out = {}, {}
    for q, d, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            else:
                seen[key] = 1
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d if q else None, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted([(d, *out[d, t or ""]) for d, t in docs], key=str)


def repeats_corpus(seed, extra=()):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(50)]
    shared = [[rng.choice(vocab) for _ in range(rng.choice((5, 19, 20, 21, 60)))] for _ in range(8)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocab) for _ in range(rng.choice((0, 3, 19, 20, 80)))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        docs.append((d * 3, rng.choice((" ", "\n", "  ")).join(w)))
    rng.shuffle(docs)
    return docs + list(extra)


@pytest.mark.parametrize("many", [4096, 2])
def test_substring(spark, monkeypatch, many):
    monkeypatch.setattr(substring, "MANY", many)
    monkeypatch.setattr(substring, "TIMES", 0)
    docs = repeats_corpus(many)
    docs += [(1000, None), (1001, " "), (1002, "a " * 500), docs[0], (None, docs[1][1]), (1003, docs[2][1])]
    df = frame(spark, docs).repartition(5)
    out = substring.substring_dedup(df)
    assert sorted([tuple(r)[:4] for r in out.collect()], key=str) == brute_substring(docs, 20)
    assert substring.substring_dedup(df.limit(0)).count() == 0


def test_equal_prefix_hash_is_no_repeat():
    """Windows are equal only if both hashes are: one that shares a single hash stays its own first."""
    key, other = np.array([7, 7, 7, 5, 7], np.uint64), np.array([1, 2, 1, 1, 3], np.uint64)
    many, first = substring.first_of(key, other, np.array([9, 0, 3, 1, 2]))
    assert dict(zip(many.tolist(), first.tolist())) == {0: 2, 2: 2, 1: 1, 4: 4}


def test_substring_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op10_substring_dedup(spark, SF).collect()], key=str) == brute_substring(docs, 20)


@given(st.lists(st.integers(0, 20), max_size=30))
def test_longest_increasing(values):
    got = licenses.longest_increasing(values)
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    assert len(got) == max(best, default=0) and all(i < j and values[i] < values[j] for i, j in zip(got, got[1:]))


@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_align(a, b):
    met = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in met) and all(i < k and j < m for (i, j), (k, m) in zip(met, met[1:]))


def test_licenses(spark):
    notice = licenses.TEMPLATES["mit-notice"]
    broken = " ".join(w for i, w in enumerate(notice.split()) if i % 9)
    rows = [(1, "intro words " * 50 + notice + " tail"), (2, broken.upper()), (3, "Released, under the\nMIT license."), (4, None), (5, ""),
            (6, "the software is free of charge"), (7, "All rights reserved " * 4000), (3, "x")]
    got = {}
    for r in licenses.license_scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.licenses)
    assert got[1] == ["mit-notice:1.000:100:182"] or got[1][0].startswith("mit-notice:1.000:100:")
    assert got[2][0].startswith("mit-notice:0.8") and got[3] == ["mit:1.000:0:5", ""] or sorted(got[3]) == ["", "mit:1.000:0:5"]
    assert got[4] == got[5] == got[6] == [""] and got[7] == ["reserved:1.000:0:3"]
    assert licenses.license_scan(frame(spark, rows).limit(0)).count() == 0


def test_repeated_notices():
    """A notice that stands more than once close together is reported with its first best place."""
    found = licenses.Templates(licenses.TEMPLATES)

    def scan(text):
        return [(found.names[t], round(share, 3), a, b) for _, t, share, a, b in found.scan(pa.array([text]))]

    assert scan("Foo. All rights reserved. X All rights reserved. Bar") == [("reserved", 1.0, 1, 4)]
    assert scan("x Released under the MIT License y Released under the MIT License z") == [("mit", 1.0, 1, 6)]
    notice = licenses.TEMPLATES["mit-notice"].split()
    n = len(words(pa.array([" ".join(notice)]), ALNUM).begin)
    broken = [w for i, w in enumerate(notice) if i % 9]
    long = [x for i, w in enumerate(notice) for x in ([w, "foreign"] if i % 5 == 0 else [w])]
    for gap in (0, 1, n // 2, n, 2 * n):
        assert scan(" ".join([*notice, *["int"] * gap, *notice, "tail"])) == [("mit-notice", 1.0, 0, n)]
        assert scan(" ".join(["x", *broken, *["int"] * gap, *notice, *["int"] * gap, *broken])) == [
            ("mit-notice", 1.0, 1 + gap + len(words(pa.array([" ".join(broken)]), ALNUM).begin), 1 + gap + len(words(pa.array([" ".join(broken)]), ALNUM).begin) + n)]
        for copy, least in ((broken, 0.8), (long, 1.0)):
            (name, share, a, _), = scan(" ".join([*copy, *["int"] * gap, *copy, *["int"] * gap, *copy]))
            assert name == "mit-notice" and share >= least and a <= 1


@pytest.mark.parametrize("text, name, share", [
    ("Released under our MIT License", "mit", 0.8), ("All rights are reserved", "reserved", 1.0),
    ("the rights of all: All rights are reserved, all of them", "reserved", 1.0), ("released x under z the q mit s license", "mit", 1.0)])
def test_no_words_in_a_row(text, name, share):
    found = licenses.Templates(licenses.TEMPLATES)
    got = {found.names[t]: s for _, t, s, _, _ in found.scan(pa.array(["x", "y z " * 40 + text + " w" * 50, None]))}
    assert got.get(name) == share


def common_words(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = max(row[j], row[j + 1], last + (x == y)), row[j + 1]
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False))
def test_every_window(rnd):
    """All stretches from all words are aligned: none that is covered enough is missed, and none is reported in vain."""
    letters = "abcdefghijkl"
    texts = {str(n): " ".join(rnd.choice(letters) for _ in range(n)) for n in (1, 2, 3, 5, 8, 15)} | {"": "", "?": "?!"}
    docs = []
    for _ in range(6):
        doc = []
        for _ in range(rnd.randrange(4)):
            doc += [rnd.choice("xyzab") for _ in range(rnd.randrange(6))]
            for w in rnd.choice([x for x in texts.values() if x != "?!"]).split():
                doc += [] if rnd.random() < 0.1 else [w]
                doc += [rnd.choice("xyzabc")] if rnd.random() < 0.3 else []
        docs.append(doc)
    found = licenses.Templates(texts)
    got = {(d, found.names[t]): (share, a, e) for d, t, share, a, e in found.scan(pa.array([" ".join(d) for d in docs]))}
    assert len(found.names) == len(texts)
    for d, doc in enumerate(docs):
        for name, text in texts.items():
            own = [w for w in text.split() if w.isalnum()]
            n = len(own)
            lost = n - -(-n * 4 // 5)
            best = max([len(licenses.align(doc[i:i + m], own)) / n for i in range(len(doc)) for m in (n, 2 * n) if doc[i] in own[:lost + 1]], default=0)
            share, a, e = got.get((d, name), (0, 0, 0))
            assert share >= best or best < licenses.COVERAGE
            assert not share or licenses.COVERAGE <= share <= common_words(doc[a:e], own) / n


def test_license_query(spark):
    """Every document with a one-line notice has it reported."""
    rows = {r.doc_id: r.licenses for r in op5_license_scan(spark, "/root/testdata/sf0.01").collect()}
    lines = {"mit": "Released under the MIT License", "apache-2.0": "Licensed under the Apache License, Version 2.0", "reserved": "All rights reserved"}
    for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        for name, line in lines.items():
            assert (f"{name}:" in rows[d.doc_id]) == (line in d.text)
