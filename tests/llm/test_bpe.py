"""BPE operators against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordspark.llm import token_files
from recordspark.llm.bpe import Encoder, encode_documents, join_tree
from recordspark.llm.queries import tokenizer_file

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = ["", " ", "a", "Hello  wörld 's 123", "tab\t here\n and  more ", "don't <|endoftext|> stop", "Éá ß Σας İstanbul", "日本語のテキスト", "x" * 300, None, "same", "same"]


def plain(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", FILES)
def test_encode_and_decode_equal_library(spark, name):
    long = " ".join(random.Random(1).choices(["alpha", "Beta!", "über", "12", "x" * 40], k=300))
    texts = [*TEXTS, long, "q" * 1500 + "é" * 700, "abc" * 900, "".join(random.Random(2).choices("abcdeéß'1.", k=3000))]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in encode_documents(docs, tokenizer_file(name), decoded=True, piece_chars=200).collect()}
    t, want = plain(name, texts)
    for i, ids in enumerate(want):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, i
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False), i


@pytest.mark.parametrize("name", FILES)
def test_tree_concatenation_of_unsplit_text(name):
    coder, rng = Encoder(tokenizer_file(name)), random.Random(3)
    for alphabet in ("ab", "the", "aé'1. ", "instruction"):
        text = "".join(rng.choices(alphabet, k=2000))
        for parts in (2, 8, 64):
            cut = [k * len(text) // parts for k in range(parts + 1)]
            pieces = [(text[a:b], *coder.spans(text[a:b])) for a, b in zip(cut, cut[1:])]
            assert join_tree(pieces, coder.spans)[1].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_runs_of_odd_texts(name):
    coder, rng = Encoder(tokenizer_file(name)), random.Random(6)
    signs = ["a", "B", "é", " ", "  ", "\n", "'", "'s", "1", ",", "!!", "µ", "²", "\xa0", "\x85", "\x1c", "Σ", "ß", "<|endoftext|>", "|>", "́", "the", " on"]
    texts = ["".join(rng.choices(signs[: rng.choice([10, 14, len(signs)])], k=rng.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n", [0, 1, 511, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, n)).view(np.uint64)
    part = token_files.IndexPart(token_files.index_bytes(keys, np.ones(n), np.arange(n) * 3))
    assert sorted(part.slots(keys)) == list(range(n))
    own, slot = part.find(keys)
    assert own.tolist() == list(range(n)) and slot["place"].tolist() == [k * 3 for k in range(n)]
    assert len(part.find(keys + np.uint64(1))[0]) <= 1


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_KEYS", 40)
    rng = random.Random(4)
    rows = [(5, "five"), (None, "none"), (None, "null key"), (2, None), (2, "two two"), (-3, "x" * 5000), (9, "")]
    rows += [(k, " ".join(rng.choices(["alpha", "Beta!", "12"], k=rng.randint(0, 20)))) for k in range(100, 300)] + [(7, "copy %d" % k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(5)
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, tokenizer_file("byte_bpe_50k.json"), 2)
    _, ids = plain("byte_bpe_50k.json", [t for _, t in rows])
    blobs = [np.array([*i, 2], "<u4").tobytes() for i in ids]
    want = sorted((k, len(b) // 4, zlib.crc32(b)) for (k, _), b in zip(rows, blobs) if k is not None)
    for asked in ([k for k, _ in rows if k is not None] + [77], [5, 7, 150, 77, -1]):
        keyed = token_files.find(spark, path, spark.createDataFrame([(k,) for k in asked] + [(None,)], "k long"))
        got = token_files.read_records(keyed, path).join(token_files.shard_starts(spark, path), "shard").collect()
        assert sorted((r.key, r.n_tokens, r.crc32) for r in got) == [w for w in want if w[0] in asked]
        # starts: ids of all records before, in ascending key order, null keys first
        sizes = sorted((-(10**9) if k is None else k, len(b) // 4) for (k, _), b in zip(rows, blobs))
        for r in got:
            low = sum(n for k, n in sizes if k < r.key)
            assert low <= r.base + r.offset <= low + sum(n for k, n in sizes if k == r.key) - r.n_tokens
            if r.key not in (2, 7):
                assert r.base + r.offset == low
    reader = token_files.TokenFiles(path)
    for (k, _), b in zip(rows, blobs):
        if k is not None:
            assert b in [x.tobytes() for x in reader.get(k)]
    assert len(reader.get(7)) == 60 and reader.get(77) == []
    token_files.write_token_files(docs.limit(0), f"{path}0", tokenizer_file("byte_bpe_50k.json"), 2)
    assert token_files.find(spark, f"{path}0", docs.select("doc_id")).count() == 0
    assert token_files.TokenFiles(f"{path}0").get(5) == []


def test_lookup_reads_constant_bytes(tmp_path):
    most = []
    for n in (1000, 100_000):
        keys = np.arange(n, dtype=np.int64).view(np.uint64)
        (tmp_path / f"{n}.mph").write_bytes(token_files.index_bytes(keys, np.ones(n), np.arange(n)))
        file = token_files._file(f"file://{tmp_path}/{n}.mph")
        part = token_files.IndexPart(file[0].open_input_file(file[1]))
        spent = []
        for k in range(0, n, n // 200):
            had = part.bytes_read
            assert part.find(keys[k : k + 1])[1]["place"].tolist() == [k]
            spent.append(part.bytes_read - had)
        most.append(sum(spent) / len(spent))
    assert all(x < 3 * 72 + 16 for x in most) and abs(most[0] - most[1]) < 40


def test_shards_follow_the_bytes(spark, tmp_path, monkeypatch):
    from recordspark.llm import token_files as files
    from recordspark.llm.queries import tokenizer_file

    monkeypatch.setattr(files, "SHARD_BYTES", 500)
    docs = spark.createDataFrame([(k, "some words of a text " * 10) for k in range(40)] + [(None, None)], "doc_id long, text string")
    path = "file://" + str(tmp_path / "t")
    files.write_token_files(docs, path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    rows = spark.read.parquet(path + "/keys").collect()
    assert len(rows) == 41 and len({r.shard for r in rows}) > 10
    order = [r.key for r in sorted(rows, key=lambda r: (r.shard, r.record))]
    assert order[0] is None and order[1:] == sorted(order[1:])
