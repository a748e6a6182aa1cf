"""k-mer tables: counting, trimming, symmetry, spectra, lookups and read profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from hetspark.functions import codes as C
from hetspark.functions import sequences as S
from hetspark.functions.checkpoints import settled
from hetspark.schema import MAX_COUNT


#: Letters that k-mers are cut from at a time.
CHUNK = 256
#: k-mers that a task opens at a time; beyond, it goes on with the next bucket.
ROOM = 1 << 21


def chunks(seqs: DataFrame, k: int, *keep: str) -> DataFrame:
    """(*keep, at, piece): a sequence in pieces that overlap by k - 1 letters; at is the place, from 0, of the first.

    Each k-mer of seqs(seq, *keep) stands in one piece alone. Cutting takes time in proportion to the length. Sequences
    of over a hundred pieces are dealt out again by piece, so that one long sequence keeps all tasks busy.
    """
    size = max(CHUNK, k)
    cut = lambda df: df.select(*keep, F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0)).alias("parts"))
    short, long = _by_length(seqs, 100 * size)

    def pieces(df: DataFrame) -> DataFrame:
        more = F.transform("parts", lambda part, i: F.struct((i * size).alias("at"), part.alias("part"), F.coalesce(F.substring(F.get(F.col("parts"), i + 1), 1, k - 1), F.lit("")).alias("next")))
        each = cut(df).select(*keep, F.explode(more).alias("p"))
        return each.select(*keep, "p.at", F.concat("p.part", "p.next").alias("piece")).where(F.length("piece") >= k)

    tasks = max(seqs.sparkSession.sparkContext.defaultParallelism, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces(short).unionByName(pieces(long).repartition(tasks))


def _by_length(seqs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Sequences up to a length, and longer ones. A column `most`, no length less than it, spares making all sequences
    twice."""
    length = F.col("most") if "most" in seqs.columns else F.length("seq")
    return seqs.where(length <= most), seqs.where(length > most)


def occurrences(reads: DataFrame, k: int) -> DataFrame:
    """(kmer): every k-mer of every read. Letters other than acgt end a run, so no k-mer spans them. Null sequences and
    those shorter than k have none."""
    runs = reads.select(F.explode(F.split(F.lower("seq"), "[^acgt]+")).alias("seq")).where(F.length("seq") >= k)
    starts = _dealt(runs, k).select("piece", F.explode(F.sequence(F.lit(1), F.length("piece") - k + 1)).alias("at"))
    return starts.select(F.substring("piece", F.col("at"), F.lit(k)).alias("kmer"))


def _dealt(runs: DataFrame, k: int) -> DataFrame:
    """chunks(), for streams without the second dealing, which a micro-batch has no use for."""
    if not runs.isStreaming:
        return chunks(runs, k)
    size = max(CHUNK, k)
    parts = runs.select(F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0)).alias("parts"))
    more = F.transform("parts", lambda part, i: F.concat(part, F.coalesce(F.substring(F.get(F.col("parts"), i + 1), 1, k - 1), F.lit(""))))
    return parts.select(F.explode(more).alias("piece")).where(F.length("piece") >= k)


def runs(reads: DataFrame, k: int) -> DataFrame:
    """(bucket, n, s0, ..., times): the k-mers of reads as runs that follow each other, n k-mers in packed letters; all
    places of a k-mer, on both strands, are in one bucket.

    A run of some six 21-mers takes the room of one, so this is what goes to shuffles instead of k-mers. Equal runs of
    a slice are one row, so that lines found everywhere burden no bucket. Short sequences are read whole, long ones as
    chunks().
    """
    whole, long = _by_length(reads, 100 * max(CHUNK, k))
    if reads.isStreaming:
        letters = reads.select("seq")
    else:
        letters = whole.select("seq").unionByName(chunks(long.select("seq"), k).select(F.col("piece").alias("seq")))
    names = [f"s{i}" for i in range(C.run_words(k)[0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = C.values(b"n".join(x for x in batch.column(0).cast(pa.binary()).to_pylist() if x))
            for at in range(0, max(0, len(v) - k + 1), C.SLICE):
                bucket, n, words = C.runs(v[at : at + C.SLICE + k - 1], k)
                rows, times = C.summed([bucket.astype(np.int64), n.astype(np.int64), *words], np.ones(len(n), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1].astype(np.int32)), *map(pa.array, rows[2:]), pa.array(times)], ["bucket", "n", *names, "times"])

    return letters.mapInArrow(run, f"bucket int, n int, {', '.join(x + ' bigint' for x in names)}, times bigint")


def by_bucket(runs: DataFrame, k: int, made: Callable[[C.Words, np.ndarray], tuple[C.Words, tuple[np.ndarray, ...]]], schema: str) -> DataFrame:
    """runs() dealt by bucket; made(kmers, times) of some whole buckets at a time, put into rows of a schema. A task
    holds its buckets' runs until they hold ROOM k-mers, and no other."""
    names = [c for c in runs.columns if c not in ("bucket", "n", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            row, words = C.opened(columns[1], columns[2:-1], k)
            made_words, more = made(words, columns[-1][row])
            yield pa.RecordBatch.from_arrays([*map(pa.array, made_words), *map(pa.array, more)], fields)

        fields = [x.split()[0] for x in schema.split(", ")]
        held, size = [], 0
        for batch in batches:
            columns = [x.to_numpy() for x in batch.columns]
            last = np.searchsorted(columns[0], columns[0][-1]) if len(batch) else 0  # the last bucket goes on in the next batch
            if size + columns[1][:last].sum() >= ROOM and (last or size):
                if last or columns[0][0] != held[-1][0][-1]:
                    yield from out([*held, [x[:last] for x in columns]])
                    held, size, columns = [], 0, [x[last:] for x in columns]
            held.append(columns)
            size += int(columns[1].sum())
        if held:
            yield from out(held)

    return runs.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "n", *names, "times").mapInArrow(run, schema)


def count_codes(reads: DataFrame, k: int, least: int = 1, by_strand: bool = False) -> DataFrame:
    """(code, count) of canonical k-mers, or of k-mers as read, that occur `least` times at least."""
    return counted_runs(runs(reads, k), k, least, by_strand)


def counted_runs(runs: DataFrame, k: int, least: int = 1, by_strand: bool = False) -> DataFrame:
    """count_codes() of what runs() has made, at once or in parts."""
    names = [f"w{i}" for i in range(len(S.word_bounds(k)))]

    def made(words: C.Words, times: np.ndarray) -> tuple[C.Words, tuple[np.ndarray, ...]]:
        words, counts = C.summed(words if by_strand else C.canonical(words, k), times)
        often = counts >= least
        return [w[often] for w in words], (counts[often],)

    found = by_bucket(runs, k, made, ", ".join(x + " bigint" for x in [*names, "count"]))
    return found.select(S.code_from([F.col(x) for x in names]).alias("code"), "count")


def strands_seen(reads: DataFrame, k: int) -> DataFrame:
    """(code, strands): canonical k-mers of reads, k up to 31, and how they are read: 1 as they are, 2 as their reverse
    complement, 3 both."""

    def made(words: C.Words, _: np.ndarray) -> tuple[C.Words, tuple[np.ndarray, ...]]:
        other = C.reverse_complement(words, k)
        turned = C.less(other, words)
        words, seen = C.summed(C.chosen(turned, other, words), np.where(turned, 1 << 32, 1))
        return words, (((seen & 0xFFFFFFFF) > 0) + 2 * (seen >> 32 > 0),)

    return by_bucket(runs(reads, k), k, made, "code bigint, strands bigint")


def spelled(codes: DataFrame, k: int) -> DataFrame:
    """(code, ...) with k-mers as strings in place of their codes."""
    return codes.select(S.kmer_of(F.col("code"), k).alias("kmer"), *(c for c in codes.columns if c != "code"))


def count_kmers(reads: DataFrame, k: int, by_strand: bool = False) -> DataFrame:
    """(kmer, count) of canonical k-mers, or of k-mers as read. Of a stream, counts combine in each task before the shuffle."""
    if not reads.isStreaming:
        return spelled(count_codes(reads, k, by_strand=by_strand), k)
    kmer = F.col("kmer") if by_strand else S.canonical(F.col("kmer"))
    return occurrences(reads, k).groupBy(kmer.alias("kmer")).agg(F.count("*").alias("count"))


def kept_codes(reads: DataFrame, k: int, least: int) -> DataFrame:
    """(code, count): what trim() leaves of counted canonical k-mers; others don't leave the tasks that count them."""
    return count_codes(reads, k, least).select("code", F.least("count", F.lit(MAX_COUNT).cast("bigint")).alias("count"))


def trim(kmers: DataFrame, least: int) -> DataFrame:
    """k-mers that occur often enough; counts are clipped to MAX_COUNT."""
    return kmers.where(F.col("count") >= least).select("kmer", F.least("count", F.lit(MAX_COUNT).cast("bigint")).alias("count"))


def symmetric(kmers: DataFrame) -> DataFrame:
    """Canonical k-mers and their reverse complements. A k-mer that is its own is not doubled. Rows are doubled where
    they are, so the table is computed once and nothing is shuffled."""
    kmer, other = F.col("kmer"), S.reverse_complement(F.col("kmer"))
    return kmers.select(F.explode(F.when(other == kmer, F.array(kmer)).otherwise(F.array(kmer, other))).alias("kmer"), "count")


def asymmetric_rows(kmers: DataFrame) -> DataFrame:
    """k-mers whose reverse complement is missing: none in a symmetric table."""
    return kmers.join(kmers.select(S.reverse_complement(F.col("kmer")).alias("kmer")), "kmer", "left_anti")


def asymmetric_codes(codes: DataFrame, k: int) -> DataFrame:
    """asymmetric_rows() of (code, count), a code once at most. Both strands of a k-mer meet under its canonical form, in
    one aggregate that combines in each task."""
    names = [f"w{i}" for i in range(len(S.word_bounds(k)))]

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *words, count = (x.to_numpy() for x in batch.columns)
            other = C.reverse_complement(words, k)
            turned = C.less(other, words)
            own = np.logical_and.reduce([a == b for a, b in zip(words, other, strict=True)])
            columns = [*C.chosen(turned, other, words), np.where(turned, 0, count), np.where(turned | own, count, 0)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], [*names, "straight", "turned"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *words, straight, turned = (x.to_numpy() for x in batch.columns)
            columns = [*C.chosen(turned > 0, C.reverse_complement(words, k), words), straight + turned]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], [*names, "count"])

    kinds = ", ".join(f"{x} bigint" for x in names)
    words = codes.select(*(w.alias(n) for w, n in zip(S.code_words(F.col("code"), k), names, strict=True)), "count")
    forms = words.mapInArrow(form, f"{kinds}, straight bigint, turned bigint")
    met = forms.groupBy(*names).agg(F.max("straight").alias("straight"), F.max("turned").alias("turned")).where("straight = 0 or turned = 0")
    return met.mapInArrow(back, f"{kinds}, count bigint").select(S.code_from([F.col(x) for x in names]).alias("code"), "count")


def symmetric_codes(codes: DataFrame, k: int) -> DataFrame:
    """symmetric() of (code, count)."""
    names = [f"w{i}" for i in range(len(S.word_bounds(k)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *words, count = (x.to_numpy() for x in batch.columns)
            other = C.reverse_complement(words, k)
            unlike = np.logical_or.reduce([a != b for a, b in zip(words, other, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b[unlike]])) for a, b in zip([*words, count], [*other, count], strict=True)], [*names, "count"])

    words = codes.select(*(w.alias(n) for w, n in zip(S.code_words(F.col("code"), k), names, strict=True)), "count")
    return words.mapInArrow(run, words.schema).select(S.code_from([F.col(x) for x in names]).alias("code"), "count")


def spectrum(kmers: DataFrame) -> DataFrame:
    """(multiplicity, n_unique, n_instances): how many k-mers occur so often, and how many occurrences that makes."""
    return kmers.groupBy(F.col("count").alias("multiplicity")).agg(F.count("*").alias("n_unique"), F.sum("count").alias("n_instances"))


def rerange(spectrum: DataFrame, low: int, high: int) -> DataFrame:
    """The spectrum within low and high; what lies outside is added to the bins at the ends."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), F.col("multiplicity"))).cast("bigint")
    return spectrum.groupBy(inside.alias("multiplicity")).agg(F.sum("n_unique").alias("n_unique"), F.sum("n_instances").alias("n_instances"))


def toggle(spectrum: DataFrame, instances: bool) -> DataFrame:
    """(value, n): the spectrum as numbers of different k-mers or of occurrences."""
    return spectrum.select(F.col("multiplicity").alias("value"), F.col("n_instances" if instances else "n_unique").alias("n"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with ordinal, the place in the order of some columns, from 0. Rows are dealt by range, sorted where they are
    and settled; a row's place is its place in its partition after the rows of the partitions before it."""
    rows = settled(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    before = W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.select(*df.columns, (F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("ordinal"))


def ordinals(kmers: DataFrame) -> DataFrame:
    """(kmer, count, ordinal): k-mers with their place in sorted order, from 0."""
    return numbered(kmers.select("kmer", "count"), "kmer")


def lookup(kmers: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(kmer) with ordinal and count of its canonical form; -1 and 0 where it is not in the table."""
    found = ordinals(kmers).withColumnRenamed("kmer", "form")
    asked = wanted.select("kmer", S.canonical(F.col("kmer")).alias("form"))
    return asked.join(found, "form", "left").select("kmer", F.coalesce("ordinal", F.lit(-1)).cast("bigint").alias("ordinal"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def lower_bound(kmers: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(kmer) with (exact, ordinal, found, count): the first k-mer of the table that is not smaller, its place and
    count, and whether it is the one asked for. Past the end: false, the table's size, null, null. wanted is distinct.

    Table and questions are numbered together; a question's place less the questions before it is its ordinal.
    """
    both = kmers.select("kmer", F.lit(1).alias("side")).unionByName(wanted.select("kmer", F.lit(0).alias("side")))
    placed = settled(numbered(both, "kmer", "side"))
    asked = numbered(placed.where("side = 0").select("kmer", F.col("ordinal").alias("place")), "kmer")
    asked = asked.select("kmer", (F.col("place") - F.col("ordinal")).alias("ordinal"))
    table = ordinals(kmers).withColumnRenamed("kmer", "found")
    return asked.join(table, "ordinal", "left").select("kmer", F.coalesce(F.col("found") == F.col("kmer"), F.lit(False)).alias("exact"), "ordinal", "found", "count")


def prefix_buckets(kmers: DataFrame, bases: int = 4) -> DataFrame:
    """(prefix, n, largest): k-mers by leading bases; largest marks those of the greatest number."""
    n = kmers.groupBy(F.substring("kmer", 1, bases).alias("prefix")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.join(most, F.col("n") == F.col("most"), "left").select("prefix", "n", F.col("most").isNotNull().alias("largest"))


def profile_runs(reads: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """(read_id, at, counts): counts of a read's k-mers along the read, 0 where a k-mer is not in codes(code, count), for
    each of its packed runs; at is the place of a run's first k-mer. Reads are expected over acgt alone.

    Runs and the table's k-mers meet by bucket: a task reads the table of some buckets first, and their runs stream past.
    """
    whole, long = _by_length(reads.where(F.length("seq") >= k), 100 * max(CHUNK, k))
    letters = whole.select("read_id", F.lit(0).cast("bigint").alias("at"), "seq").unionByName(chunks(long.select("read_id", "seq"), k, "read_id").select("read_id", F.col("at").cast("bigint"), F.col("piece").alias("seq")))
    kind = reads.schema["read_id"].dataType.simpleString()
    n_runs = C.run_words(k)[0]
    names, words = [f"s{i}" for i in range(n_runs)], len(S.word_bounds(k))
    columns = ["bucket", "side", "read_id", "at", "n", *names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            low = 0
            while low < len(texts):  # some reads of SLICE letters in all, or one
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) < C.SLICE):
                    size += len(texts[high]) + 1
                    high += 1
                lengths = np.array([len(x) + 1 for x in texts[low:high]])
                begins = np.cumsum(lengths) - lengths
                v = C.values(b"n".join(texts[low:high]))
                bucket, n, held, place = C.runs(v, k, places=True)
                row = np.searchsorted(begins, place, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.ones(len(n), np.int32)), ids.take(pa.array(row + low)), pa.array(place - begins[row] + at[low + row]), pa.array(n.astype(np.int64)), *map(pa.array, held)], columns)
                low = high

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *code, count = (x.to_numpy() for x in batch.columns)
            none = np.zeros(len(batch), np.int64)
            ids = pa.nulls(len(batch), schema.field("read_id").type)
            yield pa.RecordBatch.from_arrays([pa.array(C.bucket_of(code, k)), pa.array(none.astype(np.int32)), ids, pa.array(none), pa.array(count), *map(pa.array, [*code, *[none] * (n_runs - words)])], columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = -1, [], None
        for batch in batches:
            bucket, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(side[1:] != side[:-1]) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    if now == 1:
                        held, table = [], None
                    held.append([x.to_numpy() for x in part.columns[4 : 5 + words]])
                else:
                    if table is None:
                        table = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * (1 + words)
                    n = part.column(4).to_numpy()
                    _, found = C.opened(n, [x.to_numpy() for x in part.columns[5:]], k)
                    counts = C.looked_up(table[1:], table[0], C.canonical(found, k))
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(counts))], ["read_id", "at", "counts"])
                now = side[a]

    ints = ", ".join(f"{x} bigint" for x in names)
    kinds = f"bucket int, side int, read_id {kind}, at bigint, n bigint, {ints}"
    schema = to_arrow_schema(letters.select("read_id").schema)
    split = codes.select(*(w.alias(f"w{i}") for i, w in enumerate(S.code_words(F.col("code"), k))), "count")
    both = split.mapInArrow(file, kinds).unionByName(letters.mapInArrow(cut, kinds))
    # The table of some buckets at a time is held; a range without one finds nothing in that of the range before.
    return both.repartition("bucket").withColumn("group", F.shiftright("bucket", 24)).sortWithinPartitions("group", "side").drop("group").mapInArrow(look, f"read_id {kind}, at bigint, counts array<bigint>")


def profiles_of_codes(reads: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """profiles() by profile_runs()."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "counts"))), lambda x: x["counts"]))
    return profile_runs(reads, codes, k).groupBy("read_id").agg(whole.alias("profile")).select("read_id", F.size("profile").cast("bigint").alias("n"), "profile")


def profile_pieces(reads: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(read_id, at, counts): counts of a read's k-mers along the read, 0 where a k-mer is not in the table, for each
    of its chunks(); at is the place of the first. Reads are expected over acgt alone. No row grows with a read."""
    pieces = chunks(reads.where(F.length("seq") >= k).select("read_id", "seq"), k, "read_id")
    at = pieces.select("read_id", "at", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - k + 1)).alias("i"))
    form = at.select("read_id", "at", "i", S.canonical(F.substring("piece", F.col("i"), F.lit(k))).alias("kmer"))
    counted = form.join(kmers, "kmer", "left").select("read_id", "at", "i", F.coalesce("count", F.lit(0)).alias("count"))
    return counted.groupBy("read_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "count"))), lambda x: x["count"]).alias("counts"))


def profiles(reads: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(read_id, n, profile): profile_pieces() of each read put together, an array as long as the read."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "counts"))), lambda x: x["counts"]))
    return profile_pieces(reads, kmers, k).groupBy("read_id").agg(whole.alias("profile")).select("read_id", F.size("profile").cast("bigint").alias("n"), "profile")


def base_composition(kmers: DataFrame) -> DataFrame:
    """kmers with the number of each base and of the rarest one."""
    kmer = F.col("kmer")
    return kmers.select("kmer", "count", *(S.n_of(b, kmer).cast("bigint").alias(f"n_{b}") for b in "acgt"), S.least_base(kmer).cast("bigint").alias("least_base"))
