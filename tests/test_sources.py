import bz2
import gzip
import json
import random
import struct

import numpy as np
import pytest

from hetspark.jobs import cli
from hetspark.operators import kmers
from hetspark.sources import binary, reads, tables
from hetspark.streaming.kmers import count_available


def test_bins_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(6, 10, 2), (500, 500, 3), (2, 9, 0), (3, 4, 7)], "covB int, covA int, freq bigint")
    tables.write_bins(df, str(tmp_path / "x.smu"))
    assert [tuple(r) for r in tables.read_bins(spark, str(tmp_path / "x.smu")).collect()] == [(3, 4, 7), (6, 10, 2)]


def test_annotated(spark, tmp_path):
    p = tmp_path / "a.sma"
    p.write_text("covB\tcovA\tfreq\tsmudge\n6\t10\t2\t1A1B\n6\t10\t2\t2A1B\n7\t9\t1\t3A2B\n")
    assert {(r.covB, r.covA): r.smudge for r in tables.read_annotated(spark, str(p)).collect()} == {(6, 10): "2A1B", (7, 9): "3A2B"}
    p.write_text("covB\tcovA\tfreq\tsmudge\n6\t10\t2\t2A0B\n")
    with pytest.raises(Exception, match="not a labelled bin"):
        tables.read_annotated(spark, str(p)).collect()


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">r1 first\nACGT\nac\n>r2\n\n>r3\nggg\n")
    assert {r.name: r.seq for r in reads.from_fasta(spark, str(p)).collect()} == {"r1": "acgtac", "r2": "", "r3": "ggg"}


def test_json_reports(spark, tmp_path):
    new, old = tmp_path / "r.json", tmp_path / "in.smu"
    old.write_text("x")
    assert tables.read_json_if_newer(spark, str(new), str(old)) is None
    tables.write_json(spark, {"a": 1}, str(new))
    assert tables.read_json_if_newer(spark, str(new), str(old)) == {"a": 1}


def packed(kmer):
    bits = "".join(f"{'acgt'.index(c):02b}" for c in kmer)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def write_table(folder, k, lead, seed, n=500):
    """A binary table of random k-mers in two parts: (rows in order, counts)."""
    r = np.random.default_rng(seed)
    rows = sorted({"".join(r.choice(list("acgt"), k)) for _ in range(n)})
    counts = {s: int(r.integers(1, 60000)) for s in rows}
    index = np.zeros(256**lead, "<i8")
    for s in rows:
        index[int.from_bytes(packed(s)[:lead], "big")] += 1
    (folder / "t.ktab").write_bytes(struct.pack("<4i", k, 2, 1, lead) + np.cumsum(index).astype("<i8").tobytes())
    for i, part in enumerate((rows[:200], rows[200:]), 1):
        (folder / f".t.ktab.{i}").write_bytes(struct.pack("<iq", k, len(part)) + b"".join(packed(s)[lead:] + struct.pack("<H", counts[s]) for s in part))
    return rows, counts


@pytest.mark.parametrize("k, lead, slice_", [(6, 1, 10**6), (9, 2, 70), (8, 1, 13)])
def test_kmer_table(spark, tmp_path, monkeypatch, k, lead, slice_):
    monkeypatch.setattr(binary, "SLICE", slice_)
    monkeypatch.setattr(binary, "ROWS", 50)
    rows, counts = write_table(tmp_path, k, lead, k)
    binary.register(spark)
    df = spark.read.format("ktab").load(str(tmp_path / "t.ktab"))
    assert {x.kmer: x["count"] for x in df.collect()} == counts and (df.rdd.getNumPartitions() == 2 or slice_ < 200)
    assert [x.kmer for x in df.orderBy("ordinal").collect()] == rows
    assert sum(p.n for p in binary.KmerTableReader(str(tmp_path / "t.ktab")).partitions()) == len(rows) and all(p.n <= slice_ for p in binary.slices([500, 3]))


class Counted:
    """An opener for the scheme store:, which counts the bytes that are read of each file."""

    def __init__(self, folder):
        self.folder, self.read = str(folder), {}

    def __call__(self, path):
        assert path.startswith("store://bucket/")
        name, outer = path.removeprefix("store://bucket/"), self

        class File:
            def __init__(self):
                self.f = open(f"{outer.folder}/{name}", "rb")
                self.seek = self.f.seek

            def read(self, *n):
                raw = self.f.read(*n)
                outer.read[name] = outer.read.get(name, 0) + len(raw)
                return raw

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.f.close()

        return File()


@pytest.mark.parametrize("k, lead", [(9, 2), (8, 1), (21, 1)])
def test_seeks_read_only_what_they_need(spark, tmp_path, monkeypatch, k, lead):
    monkeypatch.setattr(binary, "SLICE", 60)
    rows, counts = write_table(tmp_path, k, lead, k)
    at = Counted(tmp_path)
    binary.register(spark, at)
    whole = spark.read.format("ktab").load("store://bucket/t.ktab")
    assert {x.kmer: x["count"] for x in whole.collect()} == counts
    full = sorted(map(tuple, whole.collect()))
    ranges = [("kmer", rows[333], rows[333]), ("kmer", rows[10], rows[13]), ("kmer", rows[-3], None), ("kmer", None, rows[1]), ("ordinal", 250, 250), ("ordinal", 480, None), ("kmer", "a" * k, "a" * k), ("kmer", "acx", None), ("kmer", "tttt", "c"), ("ordinal", 10_000, None)]
    for column, low, high in ranges:
        at_column = ("kmer", "count", "ordinal").index(column)
        want = [r for r in full if (low is None or r[at_column] >= low) and (high is None or r[at_column] <= high)]
        assert sorted(map(tuple, binary.seek(spark, "store://bucket/t.ktab", column, low, high).collect())) == want, (column, low, high)
    assert whole.count() == len(rows)
    for how, most in (({"kmer": (rows[333], rows[333])}, 2), ({"ordinal": (250, 250)}, 1), ({"kmer": (rows[10], rows[13])}, 60)):
        at.read.clear()
        reader = binary.KmerTableReader("store://bucket/t.ktab", at, **how)
        parts = reader.partitions()
        assert len(parts) == 1 and parts[0].n <= 60
        assert 1 <= sum(len(b) for p in parts for b in reader.read(p)) <= most
        assert at.read["t.ktab"] < 6000 < 8 * 256**2 and sum(n for f, n in at.read.items() if f != "t.ktab") < 800, "a few entries of the index and of one part"


def test_profiles_by_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SLICE", 2)
    (tmp_path / "p.prof").write_bytes(struct.pack("<2i", 21, 1))
    raws = [bytes([i + 1, i]) for i in range(9)]
    (tmp_path / ".p.pidx.1").write_bytes(struct.pack("<iqq", 21, 0, 9) + np.cumsum([2] * 9).astype("<i8").tobytes())
    (tmp_path / ".p.prof.1").write_bytes(b"".join(raws))
    at = Counted(tmp_path)
    binary.register(spark, at)
    df = spark.read.format("kprof").load("store://bucket/p.prof")
    assert [(r.read_id, len(r.profile)) for r in binary.seek(spark, "store://bucket/p.prof", "read_id", 5, 5).collect()] == [(5, 6)] and df.count() == 9
    reader = binary.ProfileReader("store://bucket/p.prof", at, read_id=(5, 5))
    at.read.clear()
    assert [x for p in reader.partitions() for x in reader.read(p)] == [(5, [6] * 6)] and at.read[".p.prof.1"] == 2


def test_histogram(spark, tmp_path):
    rows = [(1, 7, 7), (2, 10, 20), (3, 4, 12), (5, 2, 10), (9, 1, 9), (12, 1, 12)]
    binary.write_histogram(spark.createDataFrame(rows, "multiplicity long, n_unique long, n_instances long"), str(tmp_path / "h.hist"), 21, 2, 9)
    binary.register(spark)
    for df in (spark.read.format("khist").load(str(tmp_path / "h.hist")), binary.read_histogram(spark, f"file:{tmp_path}/h.hist")):
        assert sorted(map(tuple, df.collect())) == [(2, 17, 27), (3, 4, 12), (5, 2, 10), (9, 2, 21)]
    raw = (tmp_path / "h.hist").read_bytes()
    assert struct.unpack("<3i2q", raw[:28]) == (21, 2, 9, 27, 21) and np.frombuffer(raw[28:], "<i8").tolist() == [17, 4, 0, 2, 0, 0, 0, 2]


@pytest.mark.parametrize("slice_", [1, 10])
def test_profiles(spark, tmp_path, monkeypatch, slice_):
    monkeypatch.setattr(binary, "SLICE", slice_)
    raws = [bytes([5, 3, 0x41, 0x60 | 0x1F, 0xC0 | 0x3F, 0xFF]), b"", bytes([0x81, 0x00, 0x80, 0x10, 0x02])]
    want = [[5, 5, 5, 5, 6, 5, 4], [], [256, 272, 272, 272]]
    assert [binary.decode_profile(x) for x in raws] == want
    (tmp_path / "p.prof").write_bytes(struct.pack("<2i", 21, 2))
    for i, part in enumerate((raws[:2], raws[2:]), 1):
        ends = np.cumsum([len(x) for x in part]).astype("<i8")
        (tmp_path / f".p.pidx.{i}").write_bytes(struct.pack("<iqq", 21, 0, len(part)) + ends.tobytes())
        (tmp_path / f".p.prof.{i}").write_bytes(b"".join(part))
    binary.register(spark)
    assert {r.read_id: r.profile for r in spark.read.format("kprof").load(str(tmp_path / "p.prof")).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("k, lead, parts", [(6, 1, 3), (9, 2, 5), (21, 1, 1), (40, 2, 2)])
def test_binary_tables_written_and_read(spark, tmp_path, k, lead, parts):
    rng = random.Random(k)
    rows = sorted({("".join(rng.choices("acgt", k=k))): rng.randrange(1, 40_000) for _ in range(300)}.items())
    binary.write_kmer_table(spark.createDataFrame(rng.sample(rows, len(rows)), "kmer string, count bigint"), str(tmp_path / "w.ktab"), k, parts, lead)
    got = spark.read.format("ktab").load(str(tmp_path / "w.ktab")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(w, min(n, 32767), i) for i, (w, n) in enumerate(rows)]
    assert [r.kmer for r in binary.seek(spark, str(tmp_path / "w.ktab"), "kmer", rows[40][0], rows[44][0]).collect()] == [w for w, _ in rows[40:45]]


def test_profiles_written_and_read(spark, tmp_path):
    rng = random.Random(1)
    profiles = [[], [5], [300], [7] * 200, [0, 31, -1 + 1, 32767, 0, 32, 0, 31]] + [[rng.choice((3, 3, 3, 4, 40, 4000)) for _ in range(rng.randrange(300))] for _ in range(40)]
    assert [binary.decode_profile(binary.encode_profile(p)) for p in profiles] == profiles
    df = spark.createDataFrame([(10 * i, p) for i, p in enumerate(profiles)], "read_id bigint, profile array<int>")
    binary.write_profiles(df.repartition(3), str(tmp_path / "w.prof"), 21, 3)
    assert {r.read_id: r.profile for r in spark.read.format("kprof").load(str(tmp_path / "w.prof")).collect()} == dict(enumerate(profiles))


def test_stream_equals_batch(spark, tmp_path):
    from hetspark.operators.kmers import count_kmers

    rows = [(i, "acgtacgtagctagctagcat"[i % 7 :]) for i in range(30)]
    batch = spark.createDataFrame(rows, "read_id bigint, seq string")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {r.kmer: r["count"] for r in count_available(stream, 5).collect()} == {r.kmer: r["count"] for r in count_kmers(batch, 5).collect()}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    at = lambda name: str(tmp_path / name)  # noqa: E731  (the JVM has a working folder of its own)
    (tmp_path / "h.txt").write_text("".join(f"{i}\t{n}\n" for i, n in enumerate([9, 5, 3, 6, 8], 1)))
    cli.main(["cutoff", at("h.txt"), "L"], spark)
    assert capsys.readouterr().out == "10"
    spark.createDataFrame([("aacaa", 10), ("aagaa", 6)], "kmer string, count bigint").write.parquet(at("table"))
    cli.main(["pairs", at("table"), "-L", "2", "-o", at("out"), "--json_report"], spark)
    assert [tuple(r) for r in tables.read_bins(spark, at("out.smu")).collect()] == [(6, 10, 2)] and json.load(open("out_report.json"))["input_parameters"]["L"] == 2
    (tmp_path / "a.sma").write_text("covB\tcovA\tfreq\tsmudge\n6\t10\t2\t2A1B\n")
    cli.main(["extract", at("table"), at("a.sma"), "-o", at("lines")], spark)
    assert sorted(r.value for r in spark.read.text(at("lines")).collect()) == ["aa(c/g)aa", "tt(g/c)tt"]
    (tmp_path / "f.smu").write_text("".join(f"{b}\t{a}\t{f}\n" for b, a, f in [(5, 40, 5000), (20, 20, 4000), (20, 21, 3000), (20, 40, 2500), (7, 40, 2000), (30, 60, 900)]))
    cli.main(["peaks", at("f.smu"), "-nf", "1000", "-d", "2", "--mask_errors"], spark)
    assert capsys.readouterr().out.splitlines()[0] == "20\t20\t4000\t1"
    cli.main(["all", at("f.smu"), "-cov", "20", "-o", at("fit"), "--json_report"], spark)
    assert json.load(open("fit_report.json"))["smudges"][0] == {"structure": "AB", "count": 7000, "fraction": 0.6731}
    assert {(r.covB, r.covA): r.smudge for r in tables.read_annotated(spark, at("fit.sma")).collect()}[20, 40] == "2A1B"
    assert spark.read.parquet(at("fit_plot/boxes")).count() > 0
    cli.main(["all", at("f.smu"), "-cov_min", "18", "-cov_max", "22", "-o", at("fit2")], spark)
    (tmp_path / "sizes.tsv").write_text("AB\t7000\t0.6731\nAAB\t2500\t0.2404\n")
    cli.main(["plot", at("f.smu"), at("sizes.tsv"), "20", "-o", at("again")], spark)
    assert {r.label for r in spark.read.parquet(at("again_plot/labels")).collect()} == {"AB", "AAB"}


def test_command_line_options(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    at = lambda name: str(tmp_path / name)
    (tmp_path / "r.fastq.gz").write_bytes(gzip.compress(fastq([("a", "aacaa", "@acgt"), ("b", "aagaa", "+@@@@")] * 6).encode()))
    cli.main(["pairs", at("r.fastq.gz"), "-k", "5", "-L", "2", "-o", at("x.y"), "--json_report", "-t", "2", "-tmp", "/tmp", "--verbose"], spark)
    assert [tuple(r) for r in tables.read_bins(spark, at("x.y.smu")).collect()] == [(6, 6, 2)]
    with pytest.raises(ValueError, match="sequences are read"):
        cli.main(["pairs", at("r.bam"), "-k", "5", "-L", "2", "-o", at("z")], spark)
    (tmp_path / "s.t.smu").write_text("".join(f"{b}\t{a}\t{f}\n" for b, a, f in [(5, 40, 5000), (20, 20, 4000), (20, 21, 3000), (7, 40, 2000), (20, 90, 2500)]))
    (tmp_path / "s.t_report.json").write_text('{"of": "pairs"}')
    cli.main(["all", at("s.t.smu"), "-cov", "45", "-o", at("fit"), "--json_report", "-t", "A title", "-col_ramp", "magma", "--invert_cols", "--format", "json"], spark)
    said = capsys.readouterr()
    assert "Unexpected smudge label" in said.out and "Total kmers: 16500\n" in said.err and "User defined coverage: 45.000" in said.err
    assert json.load(open("fit_report.json"))["hetmers_input"] == {"of": "pairs"}
    assert spark.read.json(at("fit_plot/title")).first().title.startswith("A title\n1n = 45\nerr = ")
    ramp = {r.step: r.rgb for r in spark.read.json(at("fit_plot/ramp")).collect()}
    assert (ramp[0], ramp[31]) == ("#fcfdbf", "#000004")


def fastq(records):
    return "".join(f"@{name} x\n{seq}\n+\n{quality}\n" for name, seq, quality in records)


def records(n=300, seed=5):
    """Reads whose qualities start with @, look like sequences or like the third line."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("acgtACGTn") for _ in range(rng.randrange(0, 60)))
        quality = rng.choice(("@", "+", "a", "acgt", "@r1"))
        out.append((f"r{i % 7}", seq, (quality * 60)[: len(seq)]))
    return out


@pytest.fixture
def tiny_splits(spark):
    """Splits of some hundred bytes, so that records lie across them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "150")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_fastq_across_splits(spark, tmp_path, tiny_splits):
    first, second = records(), records(90, 6)
    (tmp_path / "a.fastq").write_text(fastq(first))
    (tmp_path / "b.fastq").write_text(fastq(second) + "\n\n")
    df = reads.from_fastq(spark, f"{tmp_path}/*.fastq")
    assert df.rdd.getNumPartitions() > 50
    got = {r.read_id: r.seq for r in df.collect() if r.seq or r.read_id < 390}
    assert got == {i: s.lower() for i, (_, s, _) in enumerate(first + second)}


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2"])
def test_fastq_counts_like_fasta(spark, tmp_path, tiny_splits, suffix):
    pack = {"": lambda b: b, ".gz": gzip.compress, ".bz2": bz2.compress}[suffix]
    rows = records()
    (tmp_path / f"x.fq{suffix}").write_bytes(pack(fastq(rows).encode()))
    (tmp_path / f"x.fa{suffix}").write_bytes(pack("".join(f">{n}\n{s[:20]}\n{s[20:]}\n" for n, s, _ in rows).encode()))
    (tmp_path / f"x.txt{suffix}").write_bytes(pack("".join(f"{s}\n" for _, s, _ in rows).encode()))
    counts = [sorted(map(tuple, kmers.count_kmers(reads.from_file(spark, f"{tmp_path}/x.{form}{suffix}"), 5).collect())) for form in ("fq", "fa", "txt")]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) > 300


def test_equal_names_stay_apart(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">r\nacgta\n>r\nacgtt\n>q\nccccc\n")
    got = kmers.profiles(reads.from_fasta(spark, str(tmp_path / "x.fa")), spark.createDataFrame([("acgta", 7)], "kmer string, count bigint"), 5)
    assert sorted((r.n, r.profile) for r in got.collect()) == [(1, [0]), (1, [0]), (1, [7])]


@pytest.mark.parametrize("text", ["@a\nacgt\n+\n!!!!\nb\nacgt\n+\n!!!!\n", "@a\nacgt\nacgt\n+\n!!!!\n!!!!\n@b\nacgt\n+\n!!!!\n"])
def test_records_of_other_forms_are_errors(spark, tmp_path, text):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match="not a record of four lines"):
        reads.from_fastq(spark, str(tmp_path / "x.fastq")).collect()


def test_unknown_endings_are_errors():
    assert [reads.form_of(p) for p in ("a/b.fq.gz", "file:/x.FASTA", "y.seq.zst", "z.fna")] == ["fastq", "fasta", "lines", "fasta"]
    for bad in ("x.bam", "x.gz", "x", "x.fastq.zip"):
        with pytest.raises(ValueError, match="sequences are read"):
            reads.form_of(bad)
