import base64
import hashlib
from collections import Counter

import duckdb
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from hetspark.llm import quality
from hetspark.llm.queries import SQL
from tests.llm.test_quality import slow_counts
from tests.llm.test_simhash import brute, slow_fingerprint

SF = "/root/testdata/sf0.001"


def brute_force(spark):
    import pandas as pd

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}

    def clean(text):
        n, *_, repeated = slow_counts(text)
        if n < 50 or 100 * repeated > 50 * n:
            return False
        lines = quality.read_lines([text])
        good = sum(w for w, s in zip(lines.words.tolist(), model.viterbi(lines.features), strict=True) if s)
        return good >= 0.5 * n

    left = {i: r for i, r in rows.items() if clean(r.text or "")}
    by_text = {}
    for i in sorted(left):
        by_text[left[i].text or ""] = i
    ids = sorted(by_text.values())
    label = brute([slow_fingerprint(left[i].text) for i in ids])
    first = {}
    for i, k in zip(ids, label, strict=True):
        first.setdefault(k, i)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([left[i].asDict() for i in sorted(first.values())]))
    copies = {r[0]: r[1] for r in c.execute(f"SELECT doc_id, copies FROM ({SQL['op1_mix_sources']})").fetchall()}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}, special_tokens={})
    out = Counter()
    for i, n in copies.items():
        x = known.encode_ordinary(left[i].text)
        out[i, tuple(x), len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(left[i].text.encode()).hexdigest()] += n
    return Counter({k: n for k, n in out.items() if n})


def test_against_brute_force(spark):
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_force(spark)


def test_stages_keep_the_columns(spark, make):
    docs = make([(1, "a b", "s"), (None, None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_take_any_other_columns_and_odd_rows(spark):
    """Dotted, quoted and clashing names; nulls everywhere, repeated rows, an empty and a very long text."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, long, "s", 3, "x", 1), (1, long, "s", 3, "x", 1), (2, "", "s", None, None, None), (None, None, None, None, None, None), (None, long + " end", None, 1, "y", 2), (5, "a " * 70, "t", 1, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `a.b` int, IDS string, `q``r` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r.text for r in out.collect()} <= {r[1] for r in rows}, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows)
