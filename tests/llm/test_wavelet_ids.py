"""Shard files of token ids against the tokenizer and plain arrays."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewatch.llm import wavelet_ids as w


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1300), st.integers(7, 9))
def test_matrix_is_the_sequence(ids, levels):
    a = np.array(ids, np.uint32)
    made = w.WaveletMatrix.of(a, levels)
    m = w.WaveletMatrix(made.n, made.zeros, [p.tobytes() for p in made.planes], [r.tobytes() for r in made.ranks])
    assert m.ids().tolist() == ids
    assert m.access(np.arange(len(a))).tolist() == ids
    for token in {0, 5, 70, 71, *ids[:3]}:
        assert m.occurrences(token).tolist() == np.flatnonzero(a == token).tolist()
        for before in {0, len(a) // 3, len(a)}:
            assert m.rank(token, before) == int((a[:before] == token).sum())
    assert m.rank(1 << levels) == m.rank(-1) == 0
    with pytest.raises(IndexError):
        m.select(5, np.array([int((a == 5).sum())]))


@pytest.mark.parametrize("at_once", [1, 999, 1 << 18])
def test_matrix_of_many_blocks_and_wide_ids(monkeypatch, at_once):
    monkeypatch.setattr(w, "AT_ONCE", at_once)
    a = np.random.default_rng(3).integers(0, 1 << 18, 7_000 if at_once == 1 else 70_000).astype(np.uint32)
    a[::3] = 9
    m = w.WaveletMatrix.of(a, 18)
    assert (m.ids() == a).all() and (m.occurrences(9) == np.flatnonzero(a == 9)).all()
    with pytest.raises(ValueError):
        w.WaveletMatrix.of(a, 17)


ODD = [
    "", " ", "a  b", "\n\n a", "x's 's 'll 'S", "café été 中 文 ü", "9 9 !! ?? 12 a1 b", "a\x1c b\x85 c\xa0 d", "  x   y", " lead", "trail ", "a <|endoftext|> b<|endoftext|>",
    "x" * 300_000 + " b" * 5, "word " * 90_000, "é " * 1000, "　 a   b", "a ​ b",
]


def test_pieces_give_the_ids_of_the_whole():
    encoder = w.Encoder(w.tokenizer_path())
    for _ in range(2):
        for text in ODD:
            assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text[:30]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aZsé×ɏ9 \n\t'!-中\xa0 \x1f")), max_size=30))
def test_pieces_of_any_text(text):
    encoder = test_pieces_of_any_text.__dict__.setdefault("encoder", w.Encoder(w.tokenizer_path()))
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def plain(rows):
    """(key, start, n_tokens, crc32) in order, and all ids."""
    tokenizer, out, ids = Tokenizer.from_file(w.tokenizer_path()), [], []
    for key, text in rows:
        found = tokenizer.encode(text or "", add_special_tokens=False).ids + [w.END]
        out.append((key, len(ids), len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        ids += found
    return out, ids


@pytest.mark.parametrize(("shard", "size"), [(1, 1 << 30), (500, 3000), (1 << 24, 1 << 30)])
def test_files_hold_every_document(spark, odd, tmp_path, shard, size):
    folder = str(tmp_path / "ids")
    w.write_shards(odd, folder, w.tokenizer_path(), shard_tokens=shard, range_bytes=size)
    files = w.shards(spark, folder)
    assert len(list((tmp_path / "ids").glob("part-*.parquet"))) == files.count()
    got = [tuple(r) for r in w.read_documents(files).orderBy("start").collect()]
    rows = [tuple(r) for r in odd.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").orderBy("doc_id", "h").select("doc_id", "text").collect()]
    expected, ids = plain(rows)
    assert got == expected
    whole = {r["start"]: r["ids"] for r in w.read_documents(files, with_ids=True).collect()}
    assert [i for s in sorted(whole) for i in whole[s]] == ids
    tokens = [w.END, ids[0], ids[-2], 50_255, 60_000, -1]
    assert {r.token: r.n for r in w.count_tokens(files, tokens).collect()} == {t: ids.count(t) for t in tokens}
    for t in (w.END, ids[0], 50_255):
        assert sorted(r.place for r in w.find_token(files, t).collect()) == [i for i, x in enumerate(ids) if x == t]


def test_no_documents_and_text_keys(spark, none, tmp_path):
    w.write_shards(none, str(tmp_path / "none"), w.tokenizer_path())
    assert w.read_documents(w.shards(spark, str(tmp_path / "none"))).count() == 0
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), (None, None)], "`a.key` string, body string")
    w.write_shards(docs, str(tmp_path / "keys"), w.tokenizer_path(), key="a.key", text="body")
    got = [tuple(r) for r in w.read_documents(w.shards(spark, str(tmp_path / "keys"), T.StringType())).orderBy("start").collect()]
    assert got == plain([(None, ""), ("a", "one"), ("b", "two")])[0]


def test_query(spark, sf):
    got = [tuple(r) for r in w.op11_wavelet_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text")
    assert got == plain([tuple(r) for r in docs.collect()])[0]
