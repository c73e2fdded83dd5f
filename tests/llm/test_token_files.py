import zlib

import numpy as np
import pytest
import zstandard
from tests.llm.test_bpe import BYTE, ODD, by_library

from textquarry.llm import token_files as T


def test_round_trip_and_starts(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate([*ODD, None, "wort " * 90_000, "ab" * 5000])] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, start string")
    files = T.write(docs, str(tmp_path / "out"), BYTE, 3)
    found = sorted(T.read(files).collect(), key=lambda r: r.start)
    assert len(found) == len(rows)
    before = 0
    for r, (d, t) in zip(found, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = np.array([*by_library(BYTE, t or ""), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_only_wanted_frames_are_opened_and_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} " * 3000) for k in range(60)], "doc_id long, text string")
    (path,) = [r.path for r in T.write(docs, str(tmp_path / "out"), BYTE, 1).collect()]
    reader = T.open_file(path)
    assert len(reader.sizes) > 5
    ((doc_id, _, ids),) = reader.documents({31})
    assert doc_id == 31 and ids.tolist() == [*by_library(BYTE, "text 31 " * 3000), 0] and reader.opened <= 2
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.at[2]) + 40] ^= 255
    (tmp_path / "bad").write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(T.open_file(str(tmp_path / "bad")).documents())


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = T.write(docs, str(tmp_path / "out"), BYTE)
    assert files.count() == 0 and T.read(files).count() == 0


def test_running_totals_over_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SPAN", 2)
    docs = spark.createDataFrame([(k, f"text {k} " * k) for k in range(40)], "doc_id long, text string")
    found = sorted(T.read(T.write(docs, str(tmp_path / "out"), BYTE, 7)).collect())
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:k]) for k in range(40)]


def test_small_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in T.op9_token_files(spark, "/root/testdata/sf0.001").collect()}
    before = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*by_library(BYTE, r.text), 0], "<u4")
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
