import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import arrays as A
from textquarry.llm import bpe
from tests.llm.test_near_dup import thue_morse

WORD, BYTE = bpe.public_path("word_bpe_49k.json"), bpe.public_path("byte_bpe_50k.json")
ODD = ["", " ", "a", "The cat's hat.\nIt's  'sunny' ", "x  \ny", "é ́ café", "<|endoftext|> a<|endoftext|>", "tail  \n", "\n\n  a\tb \r\n c", "!!'s!'s", " a 　b", "ΑΣ ΣΑΣ", "İI", "日本語 テキスト"]


def by_library(path, text):
    return bpe.tokenizer(path).encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="ab'st!? 1é́Σ", min_size=1, max_size=120), st.integers(3, 9))
@settings(max_examples=300, deadline=None)
def test_tree_equals_library_on_unsplit_text(text, leaf):
    text = "".join(text.split()) * 3
    for path in (WORD, BYTE):
        assert bpe.encode_long(bpe.tokenizer(path), text, leaf) == by_library(path, text)


def test_tree_on_long_runs():
    for text in ("ab" * 4000 + "!" * 3000 + "reread" * 900, "0123456789" * 700, "straßenübergang" * 500, "'s't" * 2000):
        for path in (WORD, BYTE):
            assert bpe.encode_long(bpe.tokenizer(path), text) == by_library(path, text)


@given(st.lists(st.text(alphabet="ab's! \n\t\r \u0085é<|", max_size=40), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_library(texts):
    tok = bpe.tokenizer(WORD)
    for text, (ids, decoded) in zip(texts, bpe._rows(pa.array(texts), WORD), strict=True):
        want = by_library(WORD, text)
        assert ids == " ".join(map(str, want)).encode()
        assert decoded == tok.decode(want, skip_special_tokens=False).encode()
    met = bpe.pieces(BYTE, bpe.Pieces, bpe.byte_cuts)
    data, offsets = A.texts(pa.array(texts))
    slots, at, other = met.look_up(data, offsets)
    assert not other.any()
    for k, odd in enumerate(bpe.odd_rows(data, offsets)):
        if not odd:
            assert [i for s in slots[at[k] : at[k + 1]] for i in met.flat[met.start[s] : met.start[s] + met.count[s]].tolist()] == by_library(BYTE, texts[k])


def test_query_on_odd_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None, "wort" * 5000, ODD[3]])]
    found = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string"), WORD).collect()}
    tok = bpe.tokenizer(WORD)
    for k, t, _ in rows:
        want = by_library(WORD, t or "")
        assert found[k].n_tokens == len(want)
        assert found[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256(tok.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in bpe.encoded(docs, WORD).join(docs, "doc_id").select("text", "ids", "decoded").collect():
        assert r.ids == by_library(WORD, r.text)


def test_words_with_one_hash_keep_their_own_ids(spark, monkeypatch):
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    for x in (one, two):
        ((ids, _),) = bpe._rows(pa.array([x]), WORD)
        assert ids == " ".join(map(str, by_library(WORD, x))).encode()
    # Bytes decide, whatever the hash: here all words of one length have the same one.
    monkeypatch.setattr(A, "segment_hashes", lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    texts = ["aa bb", "bb", "cc aa", "aa", "ddd"]
    for cls, cuts, path in ((bpe.WordPieces, bpe.word_cuts, WORD), (bpe.Pieces, bpe.byte_cuts, BYTE)):
        met = cls(path, cuts)
        slots, at, other = met.look_up(*A.texts(pa.array(texts)))
        assert other.tolist()[:4] == [True, True, True, False] or other.any()
        for k, odd in enumerate(other.tolist()):
            if not odd:
                assert [i for s in slots[at[k] : at[k + 1]] for i in met.flat[met.start[s] : met.start[s] + met.count[s]].tolist()] == by_library(path, texts[k])


@given(st.lists(st.text(alphabet="ab's! \n\t\r \u0085\u2003é<|", max_size=40), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_joined_pieces_equal_library(texts):
    met = bpe.BytePieces(BYTE, bpe.byte_cuts)
    extra = ["it's we'll a  b\tc\n d ", " x  y <|endoftext|> z", "übung läuft über 東京 です 🙂 ok", " 12a 3.4 ..' 's !!", "q" * 3000 + " r"]
    for joined in (1 << 14, 20):
        met.JOINED = joined
        met._forget()
        data, offsets = A.texts(pa.array([*texts, *extra]))
        slots, at, other = met.look_up(data, offsets)
        assert not other.any()
        for k, odd in enumerate(bpe.odd_rows(data, offsets)):
            if not odd:
                assert [i for s in slots[at[k] : at[k + 1]] for i in met.flat[met.start[s] : met.start[s] + met.count[s]].tolist()] == by_library(BYTE, [*texts, *extra][k])
    # A text whose tokens do not end with its pieces is encoded piece by piece.
    met.width += 1
    met._forget()
    slots, at, _ = met.look_up(*A.texts(pa.array(["one two three"])))
    assert [i for s in slots for i in met.flat[met.start[s] : met.start[s] + met.count[s]].tolist()] == by_library(BYTE, "one two three")
