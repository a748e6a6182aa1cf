import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hetspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = bpe.loaded(RAW)
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
ODD = ["", " ", "\n\n  \n", "The cat's hat isn't 12345 äöü ñandú 日本語 😀😀", "<|endoftext|>", "a" * 5000, "ab" * 700 + "é" * 400, " " * 3000 + "x", "0123456789" * 200, "\x00\x01", "w" * 256, "w" * 257, "w" * 33]


def ids_of(texts):
    flat, counts = bpe.Encoder(RANKS, P.PATTERN).encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_odd_texts():
    assert ids_of(ODD) == [KNOWN.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(texts):
    assert ids_of(texts) == [KNOWN.encode_ordinary(t) for t in texts]


def test_random_pieces_by_every_width():
    r = random.Random(1)
    texts = ["".join(r.choices("etaoinshrdlé", k=n)) for n in range(1, 300)]
    assert ids_of(texts) == [KNOWN.encode_ordinary(t) for t in texts]


def test_pair_table_holds_every_pair():
    import numpy as np

    keys = list(RANKS.pair)[::7]
    left, right = np.array([k >> 32 for k in keys], np.int32), np.array([k & 0xFFFFFFFF for k in keys], np.int32)
    assert RANKS.lookup(left, right).tolist() == [RANKS.pair[k] for k in keys]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = bpe.Encoder(RANKS, P.PATTERN)
    for t in ODD[3:6] * 2:
        assert e.encode([t])[0].tolist() == KNOWN.encode_ordinary(t)


def test_on_spark(make):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, None, None), (3, "again", "s"), (3, "again", "s")]
    got = bpe.digests(make(rows), PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len(x := KNOWN.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want
    assert bpe.digests(make([]), PATH, P.PATTERN).count() == 0


def test_columns_pass_through(make):
    from pyspark.sql import functions as F

    df = make([(1, "a b", "s")]).withColumn("ids", F.lit("old"))
    out = bpe.encode(df, PATH, P.PATTERN)
    assert out.columns == [*make([]).columns, "ids"] and out.first().ids == KNOWN.encode_ordinary("a b")


def test_unknown_ids(spark):
    with pytest.raises(Exception, match="not negative"):
        bpe.decode(spark.createDataFrame([([-1],)], "ids array<int>"), PATH).collect()
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).first().decoded == b""


def test_any_names_of_other_columns(spark):
    df = spark.createDataFrame([(1, "Hello  world", 2, "x", 3.0, 4), (2, None, 1, "y", None, 5)], "`doc id` int, text string, `a.b` int, IDS string, `q``r` double, Tokens int")
    out = bpe.encode(df, PATH, P.PATTERN, bytes_col="A.B")
    assert out.columns == ["doc id", "text", "q`r", "Tokens", "ids", "A.B"] and sorted(bytes(r[-1]) for r in out.collect()) == [b"", b"Hello  world"]
    small = bpe.packed_ids(df, PATH, P.PATTERN)
    assert small.columns == ["doc id", "a.b", "IDS", "q`r", "tokens"] and sorted(len(r[-1]) for r in small.collect()) == [0, 6]
    again = bpe.decode(out.withColumnRenamed("Tokens", "DECODED"), PATH)
    assert again.columns == ["doc id", "text", "q`r", "ids", "A.B", "decoded"] and all(r[-1] == r[-2] for r in again.collect())
    assert bpe.encode(df.where("false"), PATH, P.PATTERN).collect() == [] == bpe.packed_ids(df.where("false"), PATH, P.PATTERN).collect()


def test_narrow_texts_are_cut_alike():
    narrow, full = bpe.narrowed(P.PATTERN), bpe.regex.compile(P.PATTERN).findall
    rng = random.Random(8)
    every = [chr(c) for c in range(256)]
    for alphabet in (every, list(" \t\n\x1c\x85\xa0aZé1²½'stdmrelv_-")):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(30)))
            assert narrow(text) == full(text)
    assert bpe.finder(P.PATTERN)("aé 日本 x") == full("aé 日本 x")
    assert bpe.narrowed(r"\w+") is None is bpe.narrowed(r"(?i:a)\s") and bpe.narrowed(r"[\S]") is None


def test_pieces_by_numpy_are_those_of_the_pattern():
    assert bpe.GPT2 == P.PATTERN
    rng, find = random.Random(11), bpe.regex.compile(P.PATTERN).findall
    e = bpe.Encoder(RANKS, P.PATTERN)
    e.find = None  # so that it is not asked
    for n in range(1500):
        letters = "aslltvremdé9'' ' \n\t\xa0\x85\x1c.,-½²" if n % 4 else "".join(map(chr, range(0x100)))
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(16))) for _ in range(rng.randrange(5))]
        pieces, sizes = e.all_pieces(texts)
        assert pieces.to_pylist() == [w.encode() for t in texts for w in find(t)] and sizes.tolist() == [len(find(t)) for t in texts]


def test_texts_of_all_characters_among_others(monkeypatch):
    """Runs of texts below U+0100 and others, in one call, while rare pieces are forgotten and others stay."""
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    rng, e = random.Random(12), bpe.Encoder(RANKS, P.PATTERN)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "'s", " 日本", "\n"])
    for _ in range(40):
        texts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(6)] + ["", "the end", "x" * 300]
        ids, counts = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [KNOWN.encode_ordinary(t) for t in texts]
        assert len(e.known) == len(e.met) == len(e.counts) == len(e.starts) and len(e.flat) == e.counts.sum()
    assert len(e.known) < 200


def test_an_encoder_that_is_kept_gives_the_same_ids(monkeypatch):
    """Also where it meets more pieces than it remembers."""
    r = random.Random(3)
    monkeypatch.setattr(bpe, "_KEPT", {})
    monkeypatch.setattr(bpe, "KEPT", 50)
    for _ in range(6):
        texts = ["".join(r.choice("ab c'é\n1") for _ in range(r.randrange(200))) for _ in range(20)]
        ids, n = bpe.kept(RAW, P.PATTERN).encode(texts)
        again, m = bpe.Encoder(RANKS, P.PATTERN).encode(texts)
        assert ids.tolist() == again.tolist() and n.tolist() == m.tolist()
    assert len(bpe._KEPT) == 1
