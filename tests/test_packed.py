"""Counting by packed runs and pair searches by halves: right, and with little shuffled."""

import random
from collections import Counter

import numpy as np
import pytest

from hetspark.functions import codes as C
from hetspark.functions.sequences import word_bounds
from hetspark.jobs import catalogue
from hetspark.operators import kmers, pairs

SF = "/root/testdata/sf0.001"


def rc(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def code(s):
    return tuple(int(s[at : at + n].translate(str.maketrans("acgt", "0123")), 4) for at, n in word_bounds(len(s)))


def shuffled(spark, query):
    """Bytes that a query writes to shuffles."""

    def written():
        sc = spark.sparkContext
        empty = sc._jvm.java.util.ArrayList()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), empty)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    before = written()
    query(spark, SF).write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


@pytest.mark.parametrize("k", [1, 5, 9, 21, 25, 31, 32, 40, 62, 100])
def test_runs_hold_every_kmer_once(k):
    r = random.Random(k)
    text = "".join(r.choices("acgtnG", weights=[9, 9, 9, 9, 0.3, 1], k=2000))
    want = Counter(code(s) for i in range(len(text) - k + 1) if "n" not in (s := text[i : i + k].lower()))
    bucket, n, words = C.runs(C.values(text.encode()), k)
    row, found = C.opened(n, words, k)
    assert Counter(zip(*(w.tolist() for w in found))) == want
    place = {}
    forms = [*zip(*(w.tolist() for w in C.canonical(found, k)))]
    assert all(place.setdefault(f, b) == b for f, b in zip(forms, bucket[row].tolist()))
    assert set(forms) == {min(code(s), code(rc(s))) for i in range(len(text) - k + 1) if "n" not in (s := text[i : i + k].lower())}
    assert all(len(x) == 0 for x in C.runs(C.values(b"a" * (k - 1)), k)[:2]) and np.all(C.values("acgtNé".encode())[4:] == 4)


@pytest.mark.parametrize("k", [4, 5, 21, 40])
def test_strands_against_the_whole_table(spark, k):
    """Searches on canonical k-mers alone give what those on all k-mers of both strands give; palindromes are among them."""
    r = random.Random(k)
    base = ["".join(r.choices("acgt", k=k)) for _ in range(6)]
    if k % 2 == 0:
        base += [(h := "".join(r.choices("acgt", k=k // 2))) + rc(h) for _ in range(6)]
    seqs = set(base)
    for _ in range(150):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            s[r.randrange(k)] = r.choice("acgt")
        seqs.add("".join(s))
    if k % 2:
        seqs |= {(h := "".join(r.choices("acgt", k=k // 2))) + "c" + rc(h) for _ in range(8)}
    table = spark.createDataFrame([(s, r.choice([3, 8, 499, 600])) for s in sorted({min(s, rc(s)) for s in seqs})], "kmer string, count bigint").cache()
    all_of = lambda df: sorted(map(tuple, pairs.named(df, k).select("kmer_a", "kmer_b", "count_a", "count_b", "pos").collect()))
    whole = pairs.countable(pairs.one_away(kmers.symmetric(table), k)).cache()
    assert all_of(pairs.one_away_on_strands(table, k)) == all_of(whole) != []
    assert all_of(pairs.unique_on_strands(table, k)) == all_of(pairs.unique_pairs(whole))
    assert all_of(pairs.reverse_paired(table, k)) == all_of(pairs.self_paired(whole, k))
    degrees = lambda df: sorted((tuple(x.code) if k > 31 else x.code, x.degree) for x in df.collect())
    assert degrees(pairs.degrees_on_strands(table, k)) == degrees(pairs.degrees(whole))


@pytest.mark.parametrize("name", ["extract_pairs", "hamming1_pairs", "neighbours_of_frequent", "pair_histogram", "pairs_by_composition", "stored_pair_text", "unique_pairs", "unique_pairs_long", "kmer_degree", "self_revcomp_pairs", "kmer_symmetric_check", "streaming_kmer_count", "kmer_lookup", "kmer_lower_bound", "read_profile", "stored_profiles"])
def test_little_is_shuffled(spark, name):
    """A place of a k-mer costs some 8 bytes of shuffles in all; every k-mer under k masks cost over 100."""
    places = kmers.occurrences(catalogue._reads(spark, SF), catalogue.K).count()
    assert shuffled(spark, catalogue.QUERIES[name]) < (24 if name in ("kmer_lookup", "kmer_lower_bound", "read_profile", "stored_profiles") else 16) * places


def test_buckets_are_counted_whole(spark, monkeypatch):
    """Tasks that go on after a few k-mers count as those that hold all."""
    reads = spark.createDataFrame([(i, "".join(random.Random(i % 40).choices("acgt", k=90))) for i in range(60)] + [(99, None), (100, "acgt" * 60)], "read_id bigint, seq string").repartition(3)
    want = {x.code: x["count"] for x in kmers.count_codes(reads, 7).collect()}
    monkeypatch.setattr(kmers, "ROOM", 20)
    runs = kmers.runs(reads, 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = lambda words, times: ((s := C.summed(C.canonical(words, 7), times))[0], (s[1],))
        rows = kmers.by_bucket(runs, 7, made, "w0 bigint, count bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) and {x.w0: x["count"] for x in rows} == want


@pytest.mark.parametrize("k", [4, 5, 40])
def test_codes_without_their_other_strand(spark, k):
    r = random.Random(k)
    seqs = {"".join(r.choices("acgt", k=k)) for _ in range(60)} | {(h := "".join(r.choices("acgt", k=k // 2))) + "a" * (k % 2) + rc(h) for _ in range(6)}
    table = spark.createDataFrame([(s, i + 1) for i, s in enumerate(sorted(seqs | {rc(s) for s in sorted(seqs)[::3]}))], "kmer string, count bigint").cache()
    rows = lambda df: sorted((x.kmer, x["count"]) for x in df.collect())
    codes = pairs.coded(table, k)
    assert rows(kmers.spelled(kmers.asymmetric_codes(codes, k), k)) == rows(kmers.asymmetric_rows(table)) != []
    forms = table.where(kmers.S.canonical(kmers.F.col("kmer")) == kmers.F.col("kmer"))
    assert rows(kmers.spelled(kmers.symmetric_codes(pairs.coded(forms, k), k), k)) == rows(kmers.symmetric(forms))


def test_a_stream_keeps_no_state(spark):
    """What a stream of k-mers leaves between batches are its packed runs, no table of counts."""
    path = catalogue._folder(spark)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{SF}/documents.parque[t]")
    kmers_of = catalogue.count_available(catalogue.reads.from_documents(stream), 21, path)
    assert kmers_of.count() == catalogue._counted(spark, SF).count() and not spark.read.parquet(f"{path}/runs").isEmpty()
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/progress/state")
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_lookups_by_parts(spark, monkeypatch):
    """Questions by code give what those by k-mer do, whatever parts the table is cut into; on and beyond its ends too."""
    r = random.Random(3)
    words = sorted({"".join(r.choices("acgt", k=6)) for _ in range(500)})
    table = catalogue._stored(spark.createDataFrame([(w, i + 1) for i, w in enumerate(w for w in words[20:-20:2] if w <= rc(w))], "kmer string, count bigint"), 3)
    wanted = spark.createDataFrame([(w,) for w in words], "kmer string")
    codes = pairs.coded(wanted.withColumn("count", pairs.F.lit(1)), 6)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    monkeypatch.setattr(catalogue.stored, "PART", 7)
    found = catalogue.stored.lower_bound_codes(table, codes, 6)
    found = kmers.spelled(found.withColumn("found", pairs.S.kmer_of(pairs.F.col("found"), 6)), 6)
    assert rows(found) == rows(catalogue.stored.lower_bound(table, wanted))
    seen = kmers.strands_seen(wanted.select(pairs.F.lit(1).alias("read_id"), pairs.F.col("kmer").alias("seq")), 6)
    assert rows(kmers.spelled(catalogue.stored.lookup_codes(table, seen, 6), 6)) == rows(catalogue.stored.lookup(table, wanted))
    empty = catalogue._stored(wanted.limit(0).withColumn("count", pairs.F.lit(1).cast("bigint")), 1)
    assert {(x.exact, x.ordinal, x.found) for x in catalogue.stored.lower_bound_codes(empty, codes, 6).collect()} == {(False, 0, None)}


@pytest.mark.parametrize("k", [4, 21, 40])
def test_profiles_by_runs(spark, monkeypatch, k):
    """Profiles by packed runs are those of joined k-mers, for long reads, cut ones and a table that is not of these reads."""
    r = random.Random(k)
    seqs = ["".join(r.choices("acgt", k=n)) for n in (0, k - 1, k, k + 1, 300, 513, 30_000)]
    seqs += [seqs[4], seqs[6][:700]]
    reads = spark.createDataFrame([*enumerate(seqs)], "read_id bigint, seq string").repartition(2)
    table = kmers.trim(kmers.count_kmers(reads.where("read_id > 3"), k), 2).cache()
    monkeypatch.setattr(C, "SLICE", 500)
    rows = lambda df: sorted((x.read_id, x.n, x.profile) for x in df.collect())
    assert rows(kmers.profiles_of_codes(reads, pairs.coded(table, k), k)) == rows(kmers.profiles(reads, table, k)) != []
    v = C.values("".join(seqs).encode())
    bucket, n, words = C.runs(v, k)
    row, found = C.opened(n, words, k)
    assert (C.bucket_of(found, k) == bucket[row]).all()


@pytest.mark.parametrize("name", ["hamming2_pairs", "hamming3_pairs", "kmer_families", "family_coverage"])
def test_distant_pairs_shuffle_a_row_for_each_stretch(spark, name):
    """distance + 1 rows a k-mer, not one for each choice of parts."""
    places = kmers.occurrences(catalogue._reads(spark, SF), catalogue.K).count()
    assert shuffled(spark, catalogue.QUERIES[name]) < 32 * places


@pytest.mark.parametrize("k", [9, 40])
def test_links_of_families_come_from_one_search(spark, k):
    from tests.test_pairs import close_kmers, combinations, differing

    seqs = close_kmers(k, 120, k)
    found = pairs.linked(spark.createDataFrame([(s, 5) for s in seqs], "kmer string, count bigint"), k)
    assert sorted((x.kmer_a, x.kmer_b) for x in pairs.named(found, k).collect()) == [(a, b) for a, b in combinations(seqs, 2) if differing(a, b) in (1, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
