"""Subword encoding: greedy longest match against a plain search, both kinds of marks,
odd rows and repeated ids, files that are refused."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressroom.config import Config
from pressroom.operators import subword as S


def brute(word, pieces, suffix, unk):
    out, at = [], 0
    while at < len(word):
        fits = [(len(p), i) for p, m, i in pieces if word.startswith(p, at) and m == (at + len(p) == len(word) if suffix else at > 0)]
        if not fits:
            return [unk]
        size, i = max(fits)
        out.append(i)
        at += size
    return out


@pytest.mark.parametrize("suffix", [True, False])
def test_segments_match_a_plain_search(suffix):
    parts = ["a", "ab", "abc", "b", "ca", "c", "é", "éa", "bb"]
    pieces = tuple((p.encode(), m, 2 * k + m) for k, p in enumerate(parts) for m in (False, True) if (k + m) % 5)
    v = S.Vocabulary(pieces, suffix, 99, 100, 101, 102)
    words = ["abcab", "éab", "cabb", "bbéa", "x", "a", "abcabcé", "ca", "bca"]
    lists = pa.array([words[:4], None, [], words[4:], words], pa.list_(pa.string()))
    got = S.Segmenter(v).ids(lists).to_pylist()
    want = lambda ws: [i for w in ws for i in brute(w.encode(), pieces, suffix, 99)]
    assert got == [want(words[:4]), [], [], want(words[4:]), want(words)]
    assert S.Segmenter(v).ids(lists.slice(3, 1)).to_pylist() == [want(words[4:])]


def test_byte_alphabet_is_one_to_one():
    a = S.byte_alphabet()
    assert sorted(a.values()) == list(range(256)) and a["!"] == 33 and a["Ġ"] == 32


def test_files_and_rows(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "run", "##ning", "##s", "the", ",", "ég", "##ő"]) + "\n")
    v = S.read_piece_list(spark, str(tmp_path / "vocab.txt"))
    rows = [("a", "The, running"), ("a", "runs walk égő"), ("b", None), ("c", ""), ("a", "The, running"), (None, "the " * 30)]
    df = spark.createDataFrame(rows, "uuid string, article string")
    out = df.select("uuid", "article", S.piece_ids(spark, S.words(F.col("article")), v).alias("ids"))
    out = out.withColumn("back", S.decode(F.col("ids"), v)).collect()
    assert sorted(((r["uuid"], r["article"], tuple(r["ids"]), r["back"]) for r in out), key=str) == sorted([
        ("a", "The, running", (7, 8, 4, 5), "the , running"), ("a", "The, running", (7, 8, 4, 5), "the , running"),
        ("a", "runs walk égő", (4, 6, 1, 9, 10), "runs égő"), ("b", None, (), ""), ("c", "", (), ""),
        (None, "the " * 30, (7,) * 30, " ".join(["the"] * 30))], key=str)
    # a row in is a row out, however often an id comes
    ex = df.withColumn("input", F.lit("the run"))
    enc = S.encode(ex, v, Config(max_seq_len=8)).collect()
    assert len(enc) == len(rows) and all(r["input_ids"] == [2, 7, 4, 3, 0, 0, 0, 0] and r["attention_mask"] == [1] * 4 + [0] * 4 for r in enc)
    assert sorted(str(r["labels"]) for r in enc if r["uuid"] == "a") == sorted(
        [str([2, 4, 6, 1, 9, 10, 3, -100])] + [str([2, 7, 8, 4, 5, 3, -100, -100])] * 2)
    assert S.encode(ex.limit(0), v).count() == 0


def test_long_runs_are_several_words_and_oversized_files_are_refused(spark, tmp_path, monkeypatch):
    one = spark.range(1).select(S.words(F.lit("x" * 250)).alias("w")).first()["w"]
    assert [len(w) for w in one] == [100, 100, 50]
    monkeypatch.setattr(S, "MOST_PIECES", 2)
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "c</w>": 2}}}))
    with pytest.raises(ValueError, match="3 pieces"):
        S.read_byte_level(spark, str(tmp_path / "t.json"))
