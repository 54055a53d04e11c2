import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from storyweft.llm import tokenfiles as tf

from . import cases

PATH = public_tokenizers.path(tf.TOKENIZER)


def test_pieces_encode_as_the_whole(spark):
    rng, plain = random.Random(3), Tokenizer.from_file(PATH)
    parts = ["a", "the", ".", " ", "  ", "   ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\xa0", "　", "'s", "don't", ",", "!!", "12", "é", "日本", "𝄞", "<|endoftext|>", "<|", "A", "\x1c", "​", "\x85", tf.MARK, "ing", "́", "ß", "(", "1a", " ²"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000))]
    for cache in (tf.CACHE, 10):  # with a small one the pieces are forgotten
        encode = tf.ByteEncoder(PATH)
        before, tf.CACHE = tf.CACHE, cache
        try:
            for lo in (0, 2000, 4000):
                some = texts[lo : lo + 2100]
                ids, bounds = encode(pa.array(some))
                for k, t in enumerate(some):
                    assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
        finally:
            tf.CACHE = before


def expected(rows):
    """doc_id -> the (start, n_tokens, crc) of its rows."""
    plain, out, at = Tokenizer.from_file(PATH), {}, 0
    for i in sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0)):
        mine = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for j, t in rows if j == i]
        out[i] = (at, sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in mine))
        at += sum(map(len, mine))
    return out


def test_files_read_back(spark, tmp_path):
    hot = [(3, f"text {k % 50} of a hot id") for k in range(400)] + [(None, f"no id {k}") for k in range(90)]
    rows = [(i, t if t is None or len(t) < 30000 else t[:20000]) for i, t in cases.awkward()] + hot + [(-5, "negative"), (1 << 62, "large")]
    df = cases.documents(spark, rows).repartition(5)
    for size, keys in ((1000, 64), (1 << 20, 4096)):
        path = f"{tmp_path}/{size}"
        files = tf.token_files(df, path, shard_bytes=size, bucket_keys=keys)
        assert files.count() == len(rows) and (files.select("shard").distinct().count() > 20 or size > 1000)
        asked = tf.numbered_ids(df, 64)
        found = tf.locate(spark, path, asked)
        shown = {(r.shard, r.offset): r for r in files.collect()}
        want, got = expected(rows), {}
        for r in found.collect():
            s = shown[r.shard, r.offset]
            assert (s.doc_id, s.copy, s.n_tokens) == (r.doc_id, r.copy, r.n_tokens)
            got.setdefault(r.doc_id, []).append((s.base + r.offset, s.n_tokens, s.ids_crc32, r.copy))
        assert set(got) == set(want)
        for i, (start, mine) in want.items():
            mine_got = sorted(got[i])
            assert sorted((n, c) for _, n, c, _ in mine_got) == mine
            assert [k for *_, k in mine_got] == list(range(len(mine)))
            for s, n, *_ in mine_got:  # without a gap
                assert s == start
                start += n
        ids = {(r.doc_id, r.copy): r.ids for r in tf.fetch(spark, path, asked.where("doc_id IN (3, 7, 303) OR doc_id IS NULL").unionByName(spark.createDataFrame([(123456, 0), (3, 400)], asked.schema))).collect()}
        assert sum(i is None for i, _ in ids) == 92 and sum(i == 3 for i, _ in ids) == 401 and (123456, 0) not in ids
        assert ids[303, 0] == [*Tokenizer.from_file(PATH).encode("one two three").ids, 0]
        strange = spark.createDataFrame([(i, 0) for i in range(10**6, 10**6 + 3000)], asked.schema)
        assert tf.locate(spark, path, strange).count() == 0


def test_an_empty_table_and_large_ids(spark, tmp_path):
    empty = cases.documents(spark, []).limit(0)
    tf.token_files(empty, f"{tmp_path}/none")
    assert tf.locate(spark, f"{tmp_path}/none", tf.numbered_ids(empty)).count() == 0
    raw = tf.shard_file([None, 5], [np.array([1, 70000, 0, 9, 0])], [3, 2], 4, 8) + tf.MAGIC.encode()
    shard, keys, counts, ids = tf.read_shard(raw)
    assert (shard, keys, counts.tolist(), ids.tolist()) == (8, [None, 5], [3, 2], [1, 70000, 0, 9, 0])
    with pytest.raises(ValueError, match="cut off"):
        tf.read_shard(raw[:-1])


def test_the_hash_is_perfect_and_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 4096, 30000):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        perfect, rest = tf.PerfectHash.of(hashes)
        assert len(rest) == 0 and sorted(perfect.slots(hashes).tolist()) == list(range(n))
        assert len(perfect.bits) * 64 <= 6 * n + 64 * tf.LEVELS
    twice = np.array([5, 6, 5, 7], np.uint64)
    perfect, rest = tf.PerfectHash.of(twice)
    assert sorted(rest.tolist()) == [0, 2] and sorted(perfect.slots(twice[[1, 3]]).tolist()) == [0, 1]


def test_equal_hashes_are_listed(monkeypatch):
    rows = pd.DataFrame({"doc_id": pd.array([1, 2, 3, None], "Int64"), "copy": 0, "shard": [0, 1, 2, 3], "offset": [10, 20, 30, 40], "n_tokens": [1, 2, 3, 4]})
    plain = tf.key_hashes
    monkeypatch.setattr(tf, "key_hashes", lambda i, z, c, seed: plain(i, z, c, seed) if seed else np.where(i == 2, np.uint64(9), np.where(i == 1, np.uint64(9), plain(i, z, c, seed))))
    raw = tf.index_bytes(rows)
    there, got = tf.find(raw, rows["doc_id"], rows["copy"])
    assert there.all() and got["offset"].tolist() == [10, 20, 30, 40] and got["n"].tolist() == [1, 2, 3, 4]
