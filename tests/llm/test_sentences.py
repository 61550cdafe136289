"""SentencePiece ids and texts against the library."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldcheck.llm import sentences
from fieldcheck.llm.bpe import Pool
from fieldcheck.llm.queries import op13_sentence_pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", " a ", "a  b\n\tc", "▁", "▁x ▁▁ y▁z", "\n", "\n\n a\nb", "\r\n", "Ａﬁ ①", "é é", "\x00a\x00", "日本 語　テ", "😀😀", "<s>", "</s> <unk> <0x41>",
       "a b　c", "aaaaaaaa" * 9, " " * 100, "x" + " " * 33 + "y", "the the", "Tharesthth", "﻿a", "́e", "a​", "12345 3.14,5", "--- === ///"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sentences.Model(PATH)


def check(library, model, texts):
    ids, at = sentences.ChunkTable(model)(pa.array(texts, pa.string()))
    assert len(at) == len(texts) + 1
    for t, a, b, back in zip(texts, at[:-1], at[1:], sentences.decoded(Pool(model.bytes_of), ids, at)):
        want = library.encode(t or "")
        assert ids[a:b].tolist() == want, t
        assert back.decode() == library.decode(want), t


def test_odd_texts(library, model):
    check(library, model, [*ODD, None, " ".join(ODD), "\n".join(ODD), "".join(ODD)])
    check(library, model, [])
    check(library, model, [None])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab Te.,<s>\n\t' $1é語　▁  nthi ing"), max_size=40), max_size=6))
def test_random_texts(library, model, texts):
    check(library, model, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_characters(library, model, texts):
    check(library, model, [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)])


def test_whole_texts_as_chunks(library, model, monkeypatch):
    monkeypatch.setattr(model, "crossed", True)
    check(library, model, ODD)


def test_table_starts_anew(library, model, monkeypatch):
    monkeypatch.setattr(sentences, "MEMORY", 3)
    table = sentences.ChunkTable(model)
    for t in ("a b c d e", "e f g a", "a b"):
        assert table(pa.array([t]))[0].tolist() == library.encode(t)


def test_op13(spark, library):
    rows = {r.doc_id: r for r in op13_sentence_pieces(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark, library):
    rows = [(3, "b"), (1, None), (1, "a a"), (1, "a a"), (None, "x"), (2, "long " * 30000), (4, "l" * 100000)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    out = sentences.encode_decode(df, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len(library.encode(t or ""))) for i, t in rows)
    assert sentences.encode_decode(df.limit(0), PATH).count() == 0
    back = sentences.token_column(df, PATH, "n_tokens").collect()
    assert [(r.doc_id, r.text, r.ids, r.n_tokens) for r in back] == [(i, t, "z", library.encode(t or "")) for i, t in rows]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        sentences.Model(str(tmp_path / "m"))
