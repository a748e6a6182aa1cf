import base64
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from hetspark.llm import bpe, queries, shards

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097, 100_003])
def test_permutation(n):
    p = shards.Permutation(n, 7)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and p.indexes(slots).tolist() == list(range(n))
    if n > 100:
        assert shards.Permutation(n, 8).slots(np.arange(n)).tolist() != slots.tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def whole(spark, found):
    """The stream before the permutation, from the shards."""
    rows = sorted((r.slot, bytes(r.record)) for r in shards.records(spark, found).collect())
    assert [s for s, _ in rows] == list(range(found.n))
    at = shards.Permutation(found.n, found.key).slots(np.arange(found.n)) if found.n else []
    return b"".join(rows[i][1] for i in at)


def test_round_trip_of_bytes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "doc_id")
    stored = str(tmp_path / "in")
    docs.write.parquet(stored)
    found = shards.materialise(shards.byte_ids(spark.read.parquet(stored)), str(tmp_path / "out"), seq_len=100, rows_per_shard=300)
    assert found == shards.manifest(spark, found.folder) and found.n > 3 * 300
    stream = whole(spark, found).replace(b"\xfe", b"")
    assert Counter(stream.split(b"\xff")[:-1]) == Counter((r.text or "").encode() for r in docs.collect())
    sizes = sorted(p.stat().st_size for p in (tmp_path / "out/shards").glob("part-*"))
    assert set(sizes[1:]) == {300 * 101}
    later = shards.records(spark, found, first=450).collect()
    assert sorted(r.slot for r in later) == list(range(450, found.n))
    file = sorted((tmp_path / "out/shards").glob("part-*"))[found.place(450)[0]].read_bytes()
    assert file[found.place(450)[1] :][:100] == bytes(next(r.record for r in later if r.slot == 450))


def test_round_trip_of_token_ids(spark, make, tmp_path):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = ["a b c", None, "", "ñandú\n\n" * 300, "x"]
    encoded = bpe.encode(make([(i, t, "s") for i, t in enumerate(texts)]), path, P.PATTERN)
    found = shards.materialise(shards.short_ids(encoded), str(tmp_path / "out"), seq_len=16, width=2, end=50256, pad=50257)
    ids = np.frombuffer(whole(spark, found), "<u2")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = Counter(tuple(x[x != 50257].tolist()) for x in np.split(ids, np.flatnonzero(ids == 50256) + 1)[:-1])
    assert got == Counter((*known.encode_ordinary(t or ""), 50256) for t in texts)


def test_digests(spark, make, tmp_path):
    found = shards.materialise(shards.byte_ids(make([(1, "ab", "s"), (1, "ab", "s"), (None, None, None)])), str(tmp_path / "out"), seq_len=4, rows_per_shard=1)
    rows = shards.digests(spark, found).collect()
    assert sum(r.n_tokens for r in rows) == found.tokens == 7 and {r.offset for r in rows} == {0} and sorted(r.shard for r in rows) == sorted(r.slot for r in rows)


def test_empty(spark, make, tmp_path):
    found = shards.materialise(shards.byte_ids(make([])), str(tmp_path / "out"))
    assert found.n == 0 and shards.records(spark, found).count() == 0 and shards.digests(spark, found).count() == 0


def test_ids_out_of_range(spark):
    with pytest.raises(Exception, match="width 2"):
        shards.short_ids(spark.createDataFrame([([70000],)], "ids array<int>")).collect()


def test_the_query_writes_token_ids(spark, monkeypatch):
    kept, digests = [], shards.digests
    monkeypatch.setattr(shards, "digests", lambda s, found: kept.append(found) or digests(s, found))
    assert queries.op10_token_shards(spark, SF).count() == kept[0].n
    path = P.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    end, pad = kept[0].end, kept[0].pad
    assert kept[0].width == 2 and min(end, pad) >= known.n_vocab and end != pad
    ids = np.frombuffer(whole(spark, kept[0]), "<u2")
    got = Counter(tuple(x.tolist()) for x in np.split(ids[ids != pad], np.flatnonzero(ids[ids != pad] == end) + 1)[:-1])
    assert got == Counter((*known.encode_ordinary(r.text or ""), end) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
