"""Token counts, the automaton and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewindow.llm import token_output
from tidewindow.llm.bpe_automaton import WordBpe, bpe_encode, bpe_round_trip
from tidewindow.llm.common import tokenizer_json
from tidewindow.llm.token_counts import RankMerger, token_counts
from tidewindow.llm.token_output import ChunkEncoder, read_token_files, write_token_files

DOCS = "doc_id bigint, text string, n_bytes string, ids string"
ODD = [
    "", " ", "aaaaaaaaaaaa" * 40, "a<|endoftext|>b  <|endoftext|>", "<|startoftext|>x", "  　x\x1c y", "  \n\n  a\t\tb", "'S 's don't it'll, it's. a',b", "x" * 3000 + "abc" * 2000,
    "é ñ 漢字 🙂🙂 ‍ é ó. á, ΑΣ İ ß", "".join(chr(c) for c in range(0x20, 0x3000)), " 12345 ６７ ²", " a. b, c .d ,e\n.g,h.i", "The THE the " * 300,
]


def noise(n=400):
    r = random.Random(5)
    pieces = ["the", " ", "  ", "\n", "Tion", "'s", ".", ",", "é", "ung", "7", "42", "!!", "🙂", "\t", "_", "-", "I'LL", "zzz"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_and_chunks():
    lib, texts = library("byte_bpe_50k.json"), ODD + noise()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert RankMerger(tokenizer_json("byte_bpe_50k.json")).counts(texts) == [len(w) for w in want]
    got = ChunkEncoder(tokenizer_json("byte_bpe_50k.json")).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_chunks_that_came_again_outlive_a_full_memo(monkeypatch):
    """A cut of the memo had left the last texts' chunks alone, so that frequent ones were encoded anew."""
    monkeypatch.setattr(token_output, "MEMO", 60)
    lib, texts = library("byte_bpe_50k.json"), ["often seen. ", " often seen. ", *(f" w{k}x v{k}y u{k}z" for k in range(80))]
    coder = ChunkEncoder(tokenizer_json("byte_bpe_50k.json"))
    got = [coder.encode([t])[0] for t in [*texts[:3], texts[1], *texts[3:24]]]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in [*texts[:3], texts[1], *texts[3:24]]]
    assert len(coder.memo) <= 60 and " often" in coder.memo and " w0x" not in coder.memo
    assert [np.frombuffer(g, "<u4").tolist() for g in coder.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_are_merged_by_the_model_alone():
    """The library's splitter sees only chunks that are no single word."""
    coder, lib, seen = ChunkEncoder(tokenizer_json("byte_bpe_50k.json")), library("byte_bpe_50k.json"), []

    class Noted:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return lib.encode_batch_fast(texts, **how)

        def encode(self, text, **how):
            seen.append(text)
            return lib.encode(text, **how)

    coder.library = Noted()
    texts = ["Größe éxitoso words here. \nNext's a3 (line)\n\n", "words here, once more"]
    for _ in range(2):  # new, then from the memo
        assert [np.frombuffer(g, "<u4").tolist() for g in coder.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert "a3" in "".join(seen) and not [w for w in ("Größe", "éxitoso", "words", "here", "more") if w in "".join(seen)]
    assert len("".join(seen)) < 60, "chunks of the second time are not encoded"


def test_texts_of_a_full_memo_are_whole(monkeypatch):
    """New chunks get their ids after their text was put together, also where the memo is cut between."""
    monkeypatch.setattr(token_output, "MEMO", 25)
    lib, texts = library("byte_bpe_50k.json"), [*ODD, *noise(120)]
    coder, r = ChunkEncoder(tokenizer_json("byte_bpe_50k.json")), random.Random(3)
    for _ in range(60):
        some = r.sample(texts, r.randint(1, 3))
        assert [np.frombuffer(g, "<u4").tolist() for g in coder.encode(some)] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
        assert not coder.again.holes and not coder.memo.keys() & coder.again.keys()


def test_automaton():
    lib, texts = library("word_bpe_49k.json"), ODD + noise()
    bpe = WordBpe(tokenizer_json("word_bpe_49k.json"))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = bpe.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [bpe.decode(g) for g in got] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_every_character():
    lib, bpe = library("word_bpe_49k.json"), WordBpe(tokenizer_json("word_bpe_49k.json"))
    merger, bytes_lib = RankMerger(tokenizer_json("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    texts = [f"a {chr(c)}b1{chr(c)} {chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert bpe.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert merger.counts(texts) == [len(e.ids) for e in bytes_lib.encode_batch(texts, add_special_tokens=False)]


def rows(spark):
    return spark.createDataFrame([(1, "Hello  world", "x", None), (2, None, "x", None), (3, "", None, None), (1, "Hello  world", "y", None), (None, "abc", None, None)], DOCS)


def test_plain_texts_are_split_as_any_other():
    m = RankMerger(tokenizer_json("byte_bpe_50k.json"))
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not m.other(chr(c))]
    assert len(plain) == len(range(0x20, 0x7F)) + 3 + 3 + len(range(0xC0, 0x250)) + len(range(0x2010, 0x2028))
    for c in plain:
        for t in (c, f"a{c}b", f" {c} {c}", f"1{c}2", f"!{c}?", f"{c}{c}'s"):
            assert m.plain_split(t) == m.any_split(t), t
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice((r.choice(plain), " ", "\n", "a", "'ll", "7")) for _ in range(r.randint(0, 40)))
        assert m.split(t) == m.any_split(t), t


def test_queries_on_odd_rows(spark):
    got = token_counts(rows(spark), tokenizer_json("byte_bpe_50k.json"), limit=2).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == [(0, 3, 1, False), (1, 12, 3, True), (1, 12, 3, True), (2, 0, 0, False), (3, 0, 0, False)]
    trip = bpe_round_trip(rows(spark), tokenizer_json("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in trip) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    kept = bpe_encode(rows(spark), tokenizer_json("word_bpe_49k.json"), out="tokens")
    assert kept.columns == ["doc_id", "text", "n_bytes", "ids", "tokens"] and kept.filter("length(tokens) = 8").count() == 2
    for f in (token_counts, bpe_round_trip):
        name = "byte_bpe_50k.json" if f is token_counts else "word_bpe_49k.json"
        assert f(rows(spark).filter("false"), tokenizer_json(name)).count() == 0


def test_token_files(spark):
    texts = noise(50)
    df = spark.createDataFrame([(100 - k, t, "s") for k, t in enumerate(texts)] + [(7, None, "s")], "doc_id bigint, text string, start string")
    files = write_token_files(df, tokenizer_json("byte_bpe_50k.json"), partitions=3)
    got = {r["doc_id"]: r for r in read_token_files(files).collect()}
    lib, start = library("byte_bpe_50k.json"), 0
    for i, t in sorted([(100 - k, t) for k, t in enumerate(texts)] + [(7, "")]):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    some = read_token_files(files, spark.createDataFrame([(60,), (99,), (1000,)], "doc_id bigint")).collect()
    assert {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in some} == {i: (got[i]["start"], bytes(got[i]["ids"])) for i in (60, 99)}
    assert files.agg(F.sum("documents")).first()[0] == 51
    assert read_token_files(write_token_files(df.filter("false"), tokenizer_json("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize(("sizes", "least", "most"), [({"file_frames": 4}, 10, 13), ({"file_bytes": 1}, 40, 40), ({"partitions": 1}, 1, 1)])
def test_many_small_files_and_one_large(spark, sizes, least, most):
    texts = [(k // 2, f"word{k} " * (k + 1), "s") for k in range(38)] + [(None, "x", "s"), (None, None, "s")]  # repeated and null ids
    df = spark.createDataFrame(texts, "doc_id bigint, text string, start string")
    files = write_token_files(df, tokenizer_json("byte_bpe_50k.json"), **{"partitions": 3, **sizes})
    listed = files.collect()
    assert least <= len(listed) <= most and sum(r["documents"] for r in listed) == 40
    got = read_token_files(files).collect()
    lib, start, want = library("byte_bpe_50k.json"), 0, []
    hashes = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(((i, t or "") for i, t, _ in texts), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        n = len(lib.encode(t, add_special_tokens=False).ids) + 1
        want.append((i, start, n))
        start += n
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in got) == [(s, i, n) for i, s, n in want]
    assert sum(r["tokens"] for r in listed) == start
    some = read_token_files(files, spark.createDataFrame([(3,), (18,), (3,), (-5,)], "doc_id bigint")).collect()
    assert sorted(r["start"] for r in some) == [s for i, s, _ in want if i in (3, 18)]


def test_rows_without_an_id_are_written_by_many_tasks(spark):
    df = spark.createDataFrame([(None, f"word {k}", "s") for k in range(400)], "doc_id bigint, text string, start string")
    listed = write_token_files(df, tokenizer_json("byte_bpe_50k.json"), partitions=4).collect()
    assert len(listed) > 2 and sum(r["documents"] for r in listed) == 400 and max(r["documents"] for r in listed) < 250


def test_damaged_frame(spark, tmp_path):
    from pyarrow import fs

    from tidewindow.llm.token_output import FrameReader, FrameWriter

    path = str(tmp_path / "t.zst")
    with open(path, "wb") as f:
        w = FrameWriter(f)
        for k in range(3):
            w.add(k, bytes([k]) * 400)
        w.close()
    with fs.LocalFileSystem().open_input_file(path) as f:
        r = FrameReader(f)
        assert [r.read(k) for k in (2, 0)] == [b"\2" * 400, b"\0" * 400]
        r.check = r.check + 1
        with pytest.raises(ValueError, match="damaged"):
            r.read(1)
