"""The tokenization automaton against the tokenizers library, and against all merge orders on small vocabularies."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hetspark.llm import automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    with open(PATH, "rb") as f:
        return automaton.compiled(f.read())


def merged(word, ranks):
    """BPE as it is defined: the leftmost pair of least rank merges until none can."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_random_merges_on_all_short_words(seed):
    rng = random.Random(seed)
    merges, tokens = [], [b"a", b"b", b"c"]
    for _ in range(12):
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    ids = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    a, ranks = automaton.Automaton(merges, ids, {}), {m: i for i, m in enumerate(merges)}
    words = [bytes(w) for n in range(1, 8) for w in itertools.product(b"abc", repeat=n)]
    flat, counts = a.encode_pieces(words)
    ends = np.cumsum(counts)
    got = [[a.token[i] for i in flat[e - n : e].tolist()] for e, n in zip(ends, counts, strict=True)]
    assert got == [merged(w, ranks) for w in words]
    assert [[a.text[x] for x in a.walk(w)] for w in words] == got


def test_texts_like_the_library(tables, library):
    rng = random.Random(3)
    mixed = "".join(rng.choice(" aA1!\n\té中\U0001f600\x1c\x85") for _ in range(4000))
    every = "".join(map(chr, (c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000)))
    texts = ["", "a" * 3000, "ab" * 3000, "<|endoftext|>", "x  \n <|endoftext|><|endoftext|> y<|endof text|>", mixed, every, "don't 've  \n\n z"]
    encoder = automaton.Encoder(tables, automaton.strangers(PATH))
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, e, n in zip(texts, ends, counts, strict=True):
        assert ids[e - n : e].tolist() == library.encode(text, add_special_tokens=False).ids
    assert automaton._texts(tables, ids.tolist(), counts.tolist()) == texts


def test_broken_runs_decode_like_the_library(spark, library):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(40))]) for i in range(200)] + [(200, None), (201, [])]
    got = {r.i: r.decoded for r in automaton.decode(spark.createDataFrame(rows, "i int, ids array<int>"), PATH).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}


def test_odd_rows_and_names(spark):
    rows = [(1, "Hello  world", 2, "x", 3.0), (2, None, 1, "y", None), (2, None, 1, "y", None), (3, "", 0, "", 0.0), (4, "ü" * 20_000, 0, "", 0.0)]
    df = spark.createDataFrame(rows, "`doc id` int, text string, `a.b` int, IDS string, `q``r` double")
    out = automaton.encode(df, PATH, text_out="Decoded")
    assert out.columns == ["doc id", "text", "a.b", "q`r", "ids", "Decoded"]
    assert sorted((r[0], r[5]) for r in out.collect()) == sorted((r[0], r[1] or "") for r in rows)
    small = automaton.packed(df, PATH)
    assert small.columns == ["doc id", "a.b", "q`r", "ids"]
    again = automaton.decode(small.withColumnRenamed("a.b", "DECODED"), PATH)
    assert again.columns == ["doc id", "q`r", "ids", "decoded"]
    assert sorted((r[0], r[3]) for r in again.collect()) == sorted((r[0], r[1] or "") for r in rows)
    assert automaton.encode(df.where("false"), PATH).collect() == [] == automaton.decode(small.where("false"), PATH).collect()


def test_query_like_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    from hetspark.llm.queries import op13_automaton_bpe

    rows = {r.doc_id: tuple(r)[1:] for r in op13_automaton_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_other_files_are_errors():
    with pytest.raises(ValueError, match="byte-level"), open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        automaton.compiled(f.read())
