"""The registered queries over the k-mer operators, and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetspark.functions import sequences as S
from hetspark.functions.checkpoints import settled, use_checkpoints
from hetspark.operators import cluster, fit, intervals, kmers, pairs, report
from hetspark.sources import binary, reads, stored, tables
from hetspark.streaming.kmers import count_available

#: Parameters of the registered queries.
K, LEAST, LONG_K, RAREST, OFTEN = 21, 2, 40, 1, 5
DISTANCE, NOISE, COV = 2, 20, 7.0
LOW, HIGH = 3, 20
PROBE = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """df over all cores: a file of one row group is one partition, and every read becomes as many rows as it is long."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.from_documents(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(_reads(spark, sf_dir), K)


def _codes(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return kmers.kept_codes(_reads(spark, sf_dir), k, LEAST)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.spelled(_codes(spark, sf_dir), K)


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_kept(), counted once, for what reads it twice, as dealing by range does; kept as codes."""
    return kmers.spelled(settled(_codes(spark, sf_dir)), K)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.one_away_on_strands(_codes(spark, sf_dir), K)


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.unique_on_strands(_codes(spark, sf_dir), K)


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense coverage histogram: quantities of lines against sizes of their parts."""
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("q"))
    both = lines.join(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy(F.least("q", "p_size").alias("covB"), F.greatest("q", "p_size").alias("covA")).agg(F.count("*").alias("freq"))


def _labelled(spark: SparkSession, sf_dir: str, mask: bool = True) -> DataFrame:
    return cluster.local_aggregation(_bins(spark, sf_dir), DISTANCE, NOISE, mask)


def _genomic(labelled: DataFrame) -> int:
    return cluster.totals(labelled).first().genomic


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    return fit.cells(labelled, [COV], _genomic(labelled))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _peaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    labelled = _labelled(spark, sf_dir)
    genomic = _genomic(labelled)
    return labelled, fit.label_peaks(labelled, COV, genomic), genomic


def _proper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated bins of the structures that a file of them may hold."""
    labelled, peaks, _ = _peaks(spark, sf_dir)
    return report.annotated(labelled, peaks.where("a >= b and b > 0"))


def _net_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    genomic = _genomic(labelled)
    return report.structure_table(fit.cells(labelled, [COV], genomic).select(S.structure(F.col("a"), F.col("b")).alias("structure"), "size"), genomic)


def _given_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that suppliers' keys and nations spread over the histogram, overlapping ones among them."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    low_b, low_a = F.pmod(F.col("s_suppkey") * 7, F.lit(40)).cast("double"), F.pmod(F.col("s_suppkey") * 3, F.lit(30)).cast("double")
    cells = s.select(F.col("s_suppkey").alias("name"), low_b.alias("low_b"), (low_b + F.col("s_nationkey")).alias("high_b"), low_a.alias("low_a"), (low_a + 20).alias("high_a"))
    return intervals.given_cells(_labelled(spark, sf_dir), cells)


def _centrality(centre: str, dist: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(fit.centrality(_cells(spark, sf_dir), [COV], centre, dist), "centrality")

    return query


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.spectrum(_counted(spark, sf_dir))


def _user_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users have so many events: a histogram of multiplicities with a valley."""
    per_user = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("value"))
    return per_user.groupBy("value").agg(F.count("*").alias("n"))


def _annotated(unique: DataFrame) -> DataFrame:
    """Structures for the bins of unique pairs, as a table of structures would name them at coverage 2."""
    found = pairs.histogram(unique)
    a, b = F.greatest(F.lit(1), F.rint(F.col("covA") / 2)), F.greatest(F.lit(1), F.rint(F.col("covB") / 2))
    return found.select("covB", "covA", S.short_structure(a, b).alias("smudge"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of unique pairs, which are found once."""
    unique = settled(_unique(spark, sf_dir))
    return pairs.extract(unique, _annotated(unique), K)


def _stored(table: DataFrame, files: int | None = None) -> stored.StoredTable:
    """A k-mer table, written in order."""
    path = _folder(table.sparkSession)
    stored.write(table, path, files)
    return stored.read(table.sparkSession, path)


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored.lookup_codes(_stored(_settled(spark, sf_dir), 8), kmers.strands_seen(_reads(spark, sf_dir), K), K)
    return kmers.spelled(found, K)


def _lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = kmers.count_codes(_reads(spark, sf_dir), K, by_strand=True).select("code")
    found = stored.lower_bound_codes(_stored(_settled(spark, sf_dir), 8), asked, K)
    return kmers.spelled(found.withColumn("found", S.kmer_of(F.col("found"), K)), K)


def _inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe of the middle of a table and the exact form, for the canonical and the symmetric table."""
    kept, out = settled(_kept(spark, sf_dir)), None
    for name, table in (("canonical", kept), ("symmetric", kmers.symmetric(kept))):
        held = _stored(table, 8)
        for form, found in (("probe", stored.inspect(held, LEAST + 1, PROBE)), ("exact", stored.exact_inspection(held, LEAST + 1))):
            rows = found.select(F.lit(name).alias("table"), F.lit(form).alias("form"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def _symmetric_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their reverse complement, of the symmetric table and of the canonical one, which are counted once."""
    kept = settled(_codes(spark, sf_dir))
    return kmers.spelled(kmers.asymmetric_codes(kmers.symmetric_codes(kept, K), K).unionByName(kmers.asymmetric_codes(kept, K)), K)


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.families(pairs.linked(settled(_codes(spark, sf_dir)), K))
    return found.select(S.kmer_of(F.col("code"), K).alias("kmer"), S.kmer_of(F.col("family"), K).alias("family"))


def _family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = settled(_codes(spark, sf_dir))
    return pairs.family_coverage(pairs.families(pairs.linked(kept, K)), kept, K)


def _long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique pairs of k-mers that do not fit a long."""
    return pairs.named(pairs.unique_on_strands(_codes(spark, sf_dir, LONG_K), LONG_K), LONG_K)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours of the k-mers that occur OFTEN."""
    return pairs.neighbours_of_frequent(_pairs(spark, sf_dir), OFTEN, K)


def _away(spark: SparkSession, sf_dir: str, distance: int) -> DataFrame:
    found = pairs.away(_codes(spark, sf_dir), K, distance)
    return found.select(S.kmer_of(F.col("code_a"), K).alias("kmer_a"), S.kmer_of(F.col("code_b"), K).alias("kmer_b"), "count_a", "count_b")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmers.profiles_of_codes(_reads(spark, sf_dir), _codes(spark, sf_dir), K)
    return found.select("read_id", "n", F.array_join(F.col("profile").cast("array<string>"), ",").alias("profile"))


def _degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.degrees_on_strands(_codes(spark, sf_dir), K).select(S.kmer_of(F.col("code"), K).alias("kmer"), "degree")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, peaks, genomic = _peaks(spark, sf_dir)
    return report.wide_report(report.structure_table(peaks, genomic), cluster.totals(labelled), "lines")


def _grid_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, covs = _labelled(spark, sf_dir), fit.grid(0, LOW, HIGH)
    return _rounded(fit.centrality(fit.cells(labelled, covs, _genomic(labelled)), covs), "cov", "centrality")


def _grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    best, tested = fit.grid_search(labelled, _genomic(labelled), LOW, HIGH)
    return _rounded(tested.withColumn("best", F.lit(best)), "cov", "centrality", "best")


def _read_again(write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], table: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that writes a table and reads it back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        write(table(spark, sf_dir), path)
        return read(spark, path)

    return query


def _binary_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}.hist"
    binary.write_histogram(_spectrum(spark, sf_dir), path, K, 2, 6)
    return binary.read_histogram(spark, path)


def _binary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}.ktab"
    binary.write_kmer_table(_kept(spark, sf_dir), path, K)
    return spark.read.format("ktab").load(path)


def _binary_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}.prof"
    binary.write_profiles(kmers.profiles_of_codes(_reads(spark, sf_dir), _codes(spark, sf_dir), K), path, K)
    rows = spark.read.format("kprof").load(path)
    return rows.select("read_id", F.array_join(F.col("profile").cast("array<string>"), ",").alias("profile"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parque[t]")
    return count_available(reads.from_documents(stream), K)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kmer_count": lambda s, d: kmers.count_kmers(_reads(s, d), K, by_strand=True),
    "kmer_canonical": _counted,
    "kmer_trim": _kept,
    "kmer_symmetric": lambda s, d: kmers.symmetric(_kept(s, d)),
    "kmer_symmetric_check": _symmetric_check,
    "kmer_spectrum": _spectrum,
    "spectrum_rerange": lambda s, d: kmers.rerange(_spectrum(s, d), 2, 6),
    "spectrum_instances": lambda s, d: kmers.toggle(_spectrum(s, d), instances=True),
    "kmer_ordinals": lambda s, d: stored.ordinals(_stored(_settled(s, d))),
    "kmer_inspection": _inspection,
    "kmer_lookup": _lookup,
    "kmer_codes": lambda s, d: pairs.coded(_kept(s, d), K),
    "kmer_prefix_buckets": lambda s, d: kmers.prefix_buckets(_kept(s, d)),
    "kmer_lower_bound": _lower_bound,
    "read_profile": _profile,
    "base_composition": lambda s, d: kmers.base_composition(_kept(s, d)),
    "homopolymer_kmers": lambda s, d: kmers.count_kmers(_reads(s, d).withColumn("seq", S.collapse_runs(F.col("seq"))), K),
    "hamming1_pairs": lambda s, d: pairs.named(_pairs(s, d), K),
    "kmer_degree": _degree,
    "unique_pairs": lambda s, d: pairs.named(_unique(s, d), K),
    "pair_histogram": lambda s, d: pairs.written(pairs.histogram(_unique(s, d))),
    "self_revcomp_pairs": lambda s, d: pairs.named(pairs.reverse_paired(_codes(s, d), K), K),
    "neighbours_of_frequent": _neighbours,
    "pairs_by_composition": lambda s, d: pairs.of_base_composition(_unique(s, d), K, RAREST),
    "unique_pairs_long": _long_pairs,
    "hamming2_pairs": lambda s, d: _away(s, d, 2),
    "hamming3_pairs": lambda s, d: _away(s, d, 3),
    "kmer_families": _families,
    "family_coverage": _family_coverage,
    "extract_pairs": _extracted,
    "coverage_bins": _bins,
    "local_aggregation": lambda s, d: _labelled(s, d, mask=False),
    "local_aggregation_masked": _labelled,
    "peak_summary": lambda s, d: cluster.peak_summary(_labelled(s, d)),
    "kmer_totals": lambda s, d: _rounded(cluster.totals(_labelled(s, d)), "error_fraction"),
    "fishnet_cells": lambda s, d: _cells(s, d).select("cov", "a", "b", "size"),
    "fishnet_centres": lambda s, d: _rounded(_cells(s, d), "mean_a", "mean_b").drop("size"),
    "given_cells": _given_cells,
    "structure_table": lambda s, d: _rounded(_net_table(s, d), "rel_size"),
    "structure_table_peaks": lambda s, d: report.structure_table(*_peaks(s, d)[1:]),
    "structure_labels": lambda s, d: _peaks(s, d)[1],
    "annotated_bins": lambda s, d: report.annotated(*_peaks(s, d)[:2]),
    "centrality_mode": _centrality("mode", "theoretical_center"),
    "centrality_mean": _centrality("mean", "theoretical_center"),
    "centrality_theoretical_edge": _centrality("mode", "theoretical_edge"),
    "centrality_empirical_edge": _centrality("mode", "empirical_edge"),
    "coverage_grid_level1": _grid_level,
    "coverage_grid_search": _grid_search,
    "cutoff_lower": lambda s, d: fit.cutoff_lower(_user_histogram(s, d)),
    "cutoff_upper": lambda s, d: fit.cutoff_place(_user_histogram(s, d)),
    "weighted_percentile": lambda s, d: fit.weighted_percentile(report.pair_columns(_bins(s, d)), "total_pair_cov", "freq", 95),
    "filter_cov_quantile": lambda s, d: report.filtered(_bins(s, d), 5, 90).select("covB", "covA", "freq", "total_pair_cov"),
    "relative_coverage": lambda s, d: _rounded(report.pair_columns(_bins(s, d)), "minor_variant_rel_cov"),
    "hist_total_cov": lambda s, d: _rounded(report.weighted_histogram(report.pair_columns(_bins(s, d)), "total_pair_cov", "freq"), "low", "high"),
    "hist_relative_cov": lambda s, d: _rounded(report.weighted_histogram(report.pair_columns(_bins(s, d)), "minor_variant_rel_cov", "freq", 60), "low", "high"),
    "axis_limits": lambda s, d: report.axis_limits(_bins(s, d), COV),
    "plot_boxes": lambda s, d: _rounded(report.boxes(_bins(s, d), COV), "left", "right"),
    "plot_boxes_log": lambda s, d: _rounded(report.boxes(_bins(s, d), COV, log=True), "left", "right"),
    "rounded_cells": lambda s, d: fit.rounded_cells(_labelled(s, d), COV),
    "expected_structures": lambda s, d: _rounded(report.expected_structures(_net_table(s, d), COV, 0.03), "x"),
    "size_labels": lambda s, d: report.size_labels(_net_table(s, d)),
    "legend_ticks": lambda s, d: report.legend_ticks(_bins(s, d)),
    "legend_ticks_log": lambda s, d: report.legend_ticks(_bins(s, d), log=True),
    "iso_grid_lines": lambda s, d: _rounded(report.iso_lines(_bins(s, d), COV, 120), "x", "y"),
    "grid_labels": lambda s, d: _rounded(report.grid_labels(_bins(s, d), COV, 120), "x", "y"),
    "five_numbers": lambda s, d: report.five_numbers(_labelled(s, d)),
    "peak_coverages": lambda s, d: _rounded(report.peak_coverages(_labelled(s, d)), "least", "lower", "middle", "mean", "upper", "most"),
    "peak_map": lambda s, d: _rounded(report.peak_map(_labelled(s, d)), "x"),
    "square_bins": lambda s, d: report.square_bins(_bins(s, d)),
    "square_bins_relative": lambda s, d: report.square_bins(report.pair_columns(_bins(s, d)), "minor_variant_rel_cov", "total_pair_cov"),
    "plot_title": lambda s, d: report.titles(cluster.totals(_labelled(s, d)), "lines", COV),
    "report_wide": _report,
    "stored_bins": _read_again(tables.write_bins, tables.read_bins, _bins),
    "stored_sizes": _read_again(tables.write_sizes, tables.read_sizes, _net_table),
    "stored_histogram": _read_again(tables.write_histogram, tables.read_histogram, _user_histogram),
    "stored_annotated": _read_again(tables.write_annotated, tables.read_annotated, _proper),
    "stored_centralities": _read_again(tables.write_centralities, tables.read_centralities, lambda s, d: _grid_level(s, d).withColumn("level", F.lit(1))),
    "stored_report": _read_again(tables.write_report, tables.read_report, _report),
    "stored_pair_text": _read_again(tables.write_pair_text, tables.read_pair_text, _extracted),
    "stored_spectrum": _binary_histogram,
    "stored_kmer_table": _binary_table,
    "stored_profiles": _binary_profiles,
    "streaming_kmer_count": _stream,
}


# --- SQL -------------------------------------------------------------------------------------------------------------

_RC = "translate(reverse({0}), 'acgt', 'tgca')"
_READS = "reads AS (SELECT doc_id AS read_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM documents)"


def _occ(k: int) -> str:
    return f"{_READS}, occ AS (SELECT read_id, i AS spot, substr(seq, i, {k}) AS kmer FROM (SELECT read_id, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM reads))"


def _kept_sql(k: int) -> str:
    counted = f"{_occ(k)}, counted AS (SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS count FROM occ GROUP BY 1)"
    return f"{counted}, kept AS MATERIALIZED (SELECT kmer, least(count, 32767) AS count FROM counted WHERE count >= {LEAST})"


def _both_sql(k: int) -> str:
    return f"{_kept_sql(k)}, sym AS MATERIALIZED (SELECT kmer, count FROM kept UNION ALL SELECT {_RC.format('kmer')}, count FROM kept WHERE {_RC.format('kmer')} <> kmer)"


_OCC, _KEPT, _BOTH = _occ(K), _kept_sql(K), _both_sql(K)
_COUNTED = _KEPT.rpartition(", kept AS MATERIALIZED")[0]


def _masked(table: str, condition: str = "true", k: int = K) -> str:
    """k-mers of one mask meet by its hash; those of hashes that two k-mers have meet in a list by the mask itself, and pairs
    are made inside it."""
    return f"""holed AS MATERIALIZED (SELECT kmer, count, p AS pos, hash(p, substr(kmer, 1, p), substr(kmer, p + 2)) AS h FROM {table}, (SELECT unnest(range(0, {k})) AS p)),
    shared AS MATERIALIZED (SELECT h FROM holed GROUP BY h HAVING count(*) > 1),
    masks AS (SELECT pos, substr(kmer, 1, pos) || '.' || substr(kmer, pos + 2) AS mask, list({{'kmer': kmer, 'count': count}} ORDER BY kmer) AS members
        FROM holed SEMI JOIN shared USING (h) GROUP BY 1, 2 HAVING count(*) > 1),
    firsts AS (SELECT pos, members, unnest(range(1, len(members) + 1)) AS i FROM masks),
    couples AS (SELECT pos, members[i] AS a, unnest(members[i + 1:]) AS b FROM firsts),
    pairs AS MATERIALIZED (SELECT a.kmer AS kmer_a, b.kmer AS kmer_b, a.count AS count_a, b.count AS count_b, pos::INT AS pos FROM couples WHERE {condition})"""


def _unique_sql(k: int) -> str:
    return f"""{_both_sql(k)}, {_masked('sym', 'a.count + b.count <= 1000', k)}, degree AS MATERIALIZED (SELECT kmer, count(*) AS degree FROM (SELECT kmer_a AS kmer FROM pairs UNION ALL SELECT kmer_b FROM pairs) GROUP BY kmer),
    uniq AS (SELECT pairs.* FROM pairs JOIN degree a ON a.kmer = kmer_a AND a.degree = 1 JOIN degree b ON b.kmer = kmer_b AND b.degree = 1)"""


_PAIRS = f"{_BOTH}, {_masked('sym', 'a.count + b.count <= 1000')}"
_UNIQUE = _unique_sql(K)
_HISTOGRAM = f"{_UNIQUE}, histogram AS (SELECT least(count_a, count_b)::INT AS covB, greatest(count_a, count_b)::INT AS covA, count(*) AS freq FROM uniq GROUP BY 1, 2)"
_TWO_AWAY = f"""parts AS (SELECT kmer, count, [substr(kmer, 1, 5), substr(kmer, 6, 5), substr(kmer, 11, 5), substr(kmer, 16)] AS q FROM kept),
        filed AS (SELECT kmer, count, i * 10 + j AS choice, q[i] || '/' || q[j] AS key FROM parts, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j) WHERE i < j),
        twos AS (SELECT DISTINCT a.kmer AS kmer_a, b.kmer AS kmer_b, a.count AS count_a, b.count AS count_b FROM filed a JOIN filed b ON a.choice = b.choice AND a.key = b.key AND a.kmer < b.kmer WHERE hamming(a.kmer, b.kmer) = 2)"""
_FAMILIES = f"""{_KEPT}, {_masked('kept')}, {_TWO_AWAY}, near AS (SELECT kmer_a, kmer_b FROM pairs UNION ALL SELECT kmer_a, kmer_b FROM twos),
    links AS MATERIALIZED (SELECT kmer_a AS a, kmer_b AS b FROM near UNION ALL SELECT kmer_b, kmer_a FROM near),
    reach(kmer, family) USING KEY (kmer) AS (SELECT a, min(least(a, b)) FROM links GROUP BY a
        UNION SELECT links.a, min(reach.family) FROM reach JOIN links ON reach.kmer = links.b JOIN recurring.reach AS r ON r.kmer = links.a GROUP BY links.a, r.family HAVING min(reach.family) < r.family),
    families AS (SELECT kmer, family FROM reach)"""
_SPECTRUM = f"{_COUNTED}, spectrum AS (SELECT count AS multiplicity, count(*) AS n_unique, sum(count)::BIGINT AS n_instances FROM counted GROUP BY 1)"

_BINS = "bins AS (SELECT least(l_quantity::INT, p_size) AS covB, greatest(l_quantity::INT, p_size) AS covA, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _clustered(mask: bool) -> str:
    d = DISTANCE
    return f"""{_BINS}, ranked AS (SELECT *, row_number() OVER (ORDER BY freq DESC, covA + covB, covB) AS rank, {mask} AND covB < min(covB) OVER () + {d} AS error FROM bins),
    active AS (SELECT * FROM ranked WHERE freq >= {NOISE}),
    wide AS (SELECT *, unnest(range(covA - {d}, covA + {d} + 1)) AS a FROM active WHERE NOT error),
    looked AS (SELECT *, {d} - abs(covA - a) AS r, unnest(range(covB - ({d} - abs(covA - a)), covB + ({d} - abs(covA - a)) + 1)) AS v FROM wide),
    placed AS (SELECT rank, a * 100000 + v AS turn, CASE WHEN v <= a THEN a ELSE v END AS at_a, CASE WHEN v <= a THEN v WHEN v = covB - r THEN a ELSE v - 1 END AS at_b FROM looked),
    parents AS (SELECT p.rank, arg_max(t.rank, t.freq * 1000000000::HUGEINT - p.turn) AS parent FROM placed p JOIN active t ON t.covA = p.at_a AND t.covB = p.at_b AND t.rank < p.rank GROUP BY p.rank),
    up AS (SELECT a.rank, coalesce(p.parent, a.rank) AS parent, a.error FROM active a LEFT JOIN parents p USING (rank)),
    climb(rank, spot) AS (SELECT rank, parent FROM up UNION SELECT c.rank, u.parent FROM climb c JOIN up u ON c.spot = u.rank),
    root AS (SELECT rank, min(spot) AS top FROM climb GROUP BY rank),
    numbered AS (SELECT rank, row_number() OVER (ORDER BY rank)::INT AS number FROM up WHERE parent = rank AND NOT error),
    labelled AS (SELECT covB, covA, freq, coalesce(CASE WHEN t.error THEN -1 ELSE n.number END, 0) AS smudge
        FROM ranked LEFT JOIN root USING (rank) LEFT JOIN up t ON t.rank = root.top LEFT JOIN numbered n ON n.rank = root.top)"""


_LABELLED = _clustered(True)
_TOTALS = f"""{_LABELLED}, totals AS (SELECT sum(freq)::BIGINT AS total_kmers, coalesce(sum(freq) FILTER (smudge <> -1), 0)::BIGINT AS genomic,
    coalesce(sum(freq) FILTER (smudge > 0), 0)::BIGINT AS in_peaks, coalesce(sum(freq) FILTER (smudge = -1), 0)::BIGINT AS errors FROM labelled)"""


def _net(covs: str) -> str:
    return f"""{_TOTALS}, covs AS (SELECT unnest([{covs}])::DOUBLE AS cov),
    inside AS (SELECT l.*, cov, b, a FROM labelled l, covs, (SELECT unnest(range(1, 9))::INT AS b), (SELECT unnest(range(1, 16))::INT AS a)
        WHERE smudge <> -1 AND a >= b AND a + b <= 16 AND covB > CASE WHEN b = 1 THEN 0 ELSE cov * (b - 0.5::DOUBLE) END AND covB < cov * (b + 0.5::DOUBLE)
        AND covA > CASE WHEN a = 1 THEN 0 ELSE cov * (a - 0.5::DOUBLE) END AND covA < cov * (a + 0.5::DOUBLE)),
    cells AS (SELECT cov, a, b, sum(freq)::BIGINT AS size, arg_max(covA, freq * 1000000::BIGINT - covA * 1000 - covB) AS mode_a, arg_max(covB, freq * 1000000::BIGINT - covA * 1000 - covB) AS mode_b,
        sum(freq * covA) / sum(freq) AS mean_a, sum(freq * covB) / sum(freq) AS mean_b, min(covA) AS min_a, max(covA) AS max_a, min(covB) AS min_b, max(covB) AS max_b FROM inside GROUP BY cov, a, b)"""


_CELLS = _net(str(COV))
_NET_TABLE = f"{_CELLS}, found AS (SELECT repeat('A', a) || repeat('B', b) AS structure, sum(size)::BIGINT AS size, round_even(sum(size) / any_value(genomic)::DOUBLE, 4) AS rel_size FROM cells, totals GROUP BY 1)"
_SHORT = "CASE WHEN len(structure) > 4 THEN len(replace(structure, 'B', ''))::VARCHAR || 'A' || len(replace(structure, 'A', ''))::VARCHAR || 'B' ELSE structure END"
_PEAKS = f"""{_TOTALS}, tops AS (SELECT smudge, sum(freq)::BIGINT AS size, arg_max(covA, freq * 1000000::BIGINT - covA * 1000 - covB) AS ta, arg_max(covB, freq * 1000000::BIGINT - covA * 1000 - covB) AS tb FROM labelled WHERE smudge > 0 GROUP BY smudge),
    peaks AS (SELECT smudge, size, round_even(ta / {COV}::DOUBLE, 0)::INT AS a, round_even(tb / {COV}::DOUBLE, 0)::INT AS b FROM tops),
    shown AS (SELECT *, repeat('A', a) || repeat('B', b) AS structure FROM peaks)"""


def _central(expr: str, covs: str = str(COV)) -> str:
    """expr: the distance along one axis, with x for a or b."""
    both = " + ".join(expr.replace("@", x) for x in "ab")
    return f"WITH RECURSIVE {_net(covs)} SELECT round(covs.cov, 6) AS cov, round(coalesce(sum(({both}) * size) / sum(size), 1.0), 6) AS centrality FROM covs LEFT JOIN cells ON cells.cov = covs.cov GROUP BY covs.cov"


_EVENTS = "per_user AS (SELECT user_id, count(*) AS value FROM events GROUP BY 1), h AS (SELECT value, count(*) AS n FROM per_user GROUP BY 1)"
_PLOT = f"{_BINS}, p AS (SELECT *, covA + covB AS total_pair_cov, covB / (covA + covB) AS minor_variant_rel_cov FROM bins)"
_PERCENTILE = "(SELECT min(total_pair_cov) FROM (SELECT total_pair_cov, sum(sum(freq)) OVER (ORDER BY total_pair_cov) AS upto, sum(sum(freq)) OVER () AS whole FROM {1} GROUP BY 1) WHERE upto >= {0} / 100::DOUBLE * whole)"
_LIMITS = f"""{_PLOT}, lim AS (SELECT 0.0::DOUBLE AS x_low, 0.5::DOUBLE AS x_high, CASE WHEN edge = {COV} THEN least_ ELSE least_ - 1 END::DOUBLE AS y_low,
    CASE WHEN edge = {COV} THEN most_ ELSE least(greatest(100, 10 * {COV}), most_) END::DOUBLE AS y_high
    FROM (SELECT min(total_pair_cov) AS least_, max(total_pair_cov) AS most_, {_PERCENTILE.format(95, 'p')} AS edge FROM p))"""


def _boxes(weight: str) -> str:
    return f"""WITH {_LIMITS}, w AS (SELECT *, {weight.replace('@', 'CASE WHEN covA = covB THEN freq * 2 ELSE freq END::DOUBLE')} AS weight FROM p)
    SELECT covB, covA, round(minor_variant_rel_cov - 1.0::DOUBLE / (total_pair_cov * 2), 6) AS "left", round(least(0.5::DOUBLE, minor_variant_rel_cov + 1.0::DOUBLE / (total_pair_cov * 2)), 6) AS "right",
        (total_pair_cov - 0.5)::DOUBLE AS low, (total_pair_cov + 0.5)::DOUBLE AS high, round_even(31.0::DOUBLE * weight / (SELECT max(weight) FROM w), 0)::INT AS colour
    FROM w, lim WHERE total_pair_cov >= greatest((SELECT min(total_pair_cov) FROM w), y_low) AND total_pair_cov < y_high"""


def _histogram(value: str, bins: str) -> str:
    return f"""WITH {_PLOT}, e AS (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM p), g AS (SELECT lo, hi, hi - lo AS span, {bins}::INT AS k FROM e),
    binned AS (SELECT least(floor(({value} - lo) / span * k)::INT, k - 1) AS bin, lo, span, k, freq FROM p, g)
    SELECT bin, round(lo + bin * span / k, 6) AS low, round(lo + (bin + 1) * span / k, 6) AS high, sum(freq)::BIGINT AS n FROM binned GROUP BY bin, lo, span, k"""


def _legend(raw: str) -> str:
    steps = {"linear": "0, 1, 2, 3, 4, 5, 6", "log": "0, 3.5, 4, 4.5, 5, 5.5, 6"}["log" if "pow" in raw else "linear"]
    return f"""WITH {_BINS}, m AS (SELECT max(CASE WHEN covA = covB THEN freq * 2 ELSE freq END)::DOUBLE AS top FROM bins), s AS (SELECT [{steps}]::DOUBLE[] AS x),
    t AS (SELECT unnest(range(0, 7))::INT AS tick), r AS (SELECT tick, {raw} AS raw FROM m, s, t)
    SELECT tick, CASE WHEN raw > 1000 THEN round_even(raw / 1000, 0) * 1000 WHEN raw > 100 THEN round_even(raw / 100, 0) * 100 ELSE round_even(raw / 10, 0) * 10 END::BIGINT AS value FROM r"""


def _wide() -> str:
    columns = ", ".join(f"coalesce(sum(size) FILTER (label = '{n}'), 0)::BIGINT AS \"{n}\"" for n in report.report_labels())
    return f"WITH RECURSIVE {_PEAKS}, named AS (SELECT {_SHORT} AS label, size FROM shown) SELECT 'lines' AS dataset, any_value(total_kmers) AS total_kmers, any_value(errors) AS total_error_kmers, {columns} FROM totals LEFT JOIN named ON true"


def _squares(x: str, y: str, n: int = 40) -> str:
    at = lambda c: f"least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE * {n})::INT, {n - 1})"
    return f"WITH {_PLOT}, s AS (SELECT {at(x)} AS bin_x, {at(y)} AS bin_y, freq FROM p) SELECT bin_x, bin_y, sum(freq)::BIGINT AS freq FROM s GROUP BY 1, 2"


def _grid_sql() -> str:
    """Three grids, each around the whole part of the best of the one before, and half the last best."""
    away = " + ".join(f"abs((mode_{x} - cells.cov * {x}) / cells.cov)" for x in "ab")
    body, inside = _net("0").split(", covs AS ", 1)
    inside = inside.split("inside AS", 1)[1]
    out, covs = body, [f"(SELECT unnest([{', '.join(map(repr, fit.grid(0, LOW, HIGH)))}])::DOUBLE AS cov)"]
    for start, end, step in fit.GRIDS[1:]:
        first = f"(trunc(best) + {start}::DOUBLE)"
        covs.append(f"(SELECT {first} + unnest(range(0, ceil((trunc(best) + {end}::DOUBLE - {first}) / {step}::DOUBLE)::INT)) * {step}::DOUBLE AS cov FROM best{{}})")
    covs.append("(SELECT best / 2 AS cov FROM best{})")
    for i, grid in enumerate(covs, 1):
        part = f"inside{i} AS{inside}".replace("labelled l, covs", f"labelled l, covs{i}").replace("cells AS (", f"cells{i} AS (").replace("FROM inside GROUP", f"FROM inside{i} GROUP")
        out += f", covs{i} AS {grid.format(i - 1)}, {part}, tested{i} AS (SELECT c.cov, coalesce(sum(({away}) * size) / sum(size), 1.0) AS centrality FROM covs{i} c LEFT JOIN cells{i} AS cells ON cells.cov = c.cov GROUP BY c.cov)"
        out += f", best{i} AS (SELECT arg_min(cov, (centrality, cov)) AS best, min(centrality) AS least FROM tested{i})"
    rows = " UNION ALL ".join(f"SELECT {min(i, 3)} AS level, cov, centrality FROM tested{i}" for i in range(1, 5))
    return f"WITH RECURSIVE {out} SELECT level, round(cov, 6) AS cov, round(centrality, 6) AS centrality, (SELECT round(CASE WHEN best4.least < best3.least THEN best4.best ELSE best3.best END, 6) FROM best3, best4) AS best FROM ({rows})"


SQL: dict[str, str] = {
    "kmer_count": f"WITH {_OCC} SELECT kmer, count(*) AS count FROM occ GROUP BY kmer",
    "kmer_canonical": f"WITH {_COUNTED} SELECT * FROM counted",
    "kmer_trim": f"WITH {_KEPT} SELECT * FROM kept",
    "kmer_symmetric": f"WITH {_BOTH} SELECT * FROM sym",
    "kmer_symmetric_check": f"WITH {_KEPT} SELECT * FROM kept WHERE {_RC.format('kmer')} <> kmer",
    "kmer_spectrum": f"WITH {_SPECTRUM} SELECT * FROM spectrum",
    "spectrum_rerange": f"WITH {_SPECTRUM} SELECT greatest(2, least(6, multiplicity)) AS multiplicity, sum(n_unique)::BIGINT AS n_unique, sum(n_instances)::BIGINT AS n_instances FROM spectrum GROUP BY 1",
    "spectrum_instances": f"WITH {_SPECTRUM} SELECT multiplicity AS value, n_instances AS n FROM spectrum",
    "kmer_ordinals": f"WITH {_KEPT} SELECT kmer, count, row_number() OVER (ORDER BY kmer) - 1 AS ordinal FROM kept",
    "kmer_lookup": f"""WITH {_KEPT}, placed AS (SELECT kmer, count, row_number() OVER (ORDER BY kmer) - 1 AS ordinal FROM kept), wanted AS (SELECT DISTINCT kmer FROM occ)
        SELECT w.kmer, coalesce(ordinal, -1) AS ordinal, coalesce(count, 0) AS count FROM wanted w LEFT JOIN placed p ON p.kmer = least(w.kmer, {_RC.format('w.kmer')})""",
    "kmer_lower_bound": f"""WITH {_KEPT}, placed AS (SELECT kmer AS found, count, row_number() OVER (ORDER BY kmer) - 1 AS ordinal FROM kept), wanted AS (SELECT DISTINCT kmer FROM occ)
        SELECT kmer, coalesce(found = kmer, false) AS exact, coalesce(ordinal, (SELECT count(*) FROM kept)) AS ordinal, found, count FROM wanted ASOF LEFT JOIN placed ON placed.found >= wanted.kmer""",
    "kmer_inspection": f"""WITH {_BOTH}, tables AS (SELECT 'canonical' AS "table", kmer, count FROM kept UNION ALL SELECT 'symmetric', kmer, count FROM sym),
        placed AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY kmer) - 1 AS place, count(*) OVER (PARTITION BY "table") AS n, {_RC.format('kmer')} AS other FROM tables),
        probed AS (SELECT "table", count(*) AS probed, min(count) AS least_count FROM placed WHERE n <= {PROBE} OR (place >= n // 2 - {PROBE // 2} AND place < n // 2 - {PROBE // 2} + {PROBE}) GROUP BY 1),
        asked AS (SELECT "table", arg_min(other, place) AS other FROM placed WHERE place >= 1 AND other <> kmer GROUP BY 1),
        whole AS (SELECT p."table", count(*) AS probed, min(p.count) AS least_count, count(*) FILTER (q.kmer IS NULL) = 0 AS is_symmetric FROM placed p LEFT JOIN tables q ON q."table" = p."table" AND q.kmer = p.other GROUP BY 1)
        SELECT "table", 'probe' AS form, probed, least_count, least_count >= {LEAST + 1} AS trimmed, EXISTS (SELECT 1 FROM tables t WHERE t."table" = probed."table" AND t.kmer = asked.other) AS is_symmetric FROM probed JOIN asked USING ("table")
        UNION ALL SELECT "table", 'exact', probed, least_count, least_count >= {LEAST + 1}, is_symmetric FROM whole""",
    "kmer_codes": f"WITH {_KEPT} SELECT (list_sum(list_transform(range(1, {K + 1}), lambda i: (instr('acgt', substr(kmer, i, 1)) - 1)::BIGINT << (2 * ({K} - i)))))::BIGINT AS code, count FROM kept",
    "kmer_prefix_buckets": f"WITH {_KEPT}, n AS (SELECT substr(kmer, 1, 4) AS prefix, count(*) AS n FROM kept GROUP BY 1) SELECT prefix, n, n = max(n) OVER () AS largest FROM n",
    "read_profile": f"WITH {_KEPT} SELECT read_id, count(*) AS n, string_agg(coalesce(count, 0)::VARCHAR, ',' ORDER BY spot) AS profile FROM occ LEFT JOIN kept ON kept.kmer = least(occ.kmer, {_RC.format('occ.kmer')}) GROUP BY read_id",
    "base_composition": f"WITH {_KEPT} SELECT kmer, count, " + ", ".join(f"{K} - len(replace(kmer, '{b}', '')) AS n_{b}" for b in "acgt") + ", least(" + ", ".join(f"{K} - len(replace(kmer, '{b}', ''))" for b in "acgt") + ") AS least_base FROM kept",
    "homopolymer_kmers": f"""WITH raw AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM documents),
        reads AS (SELECT doc_id AS read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'a+', 'a', 'g'), 'c+', 'c', 'g'), 'g+', 'g', 'g'), 't+', 't', 'g') AS seq FROM raw),
        {_COUNTED.split(', occ AS', 1)[1].join(['occ AS', ''])} SELECT * FROM counted""",
    "hamming1_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "kmer_degree": f"WITH {_UNIQUE} SELECT * FROM degree",
    "unique_pairs": f"WITH {_UNIQUE} SELECT * FROM uniq",
    "pair_histogram": f"WITH {_HISTOGRAM} SELECT * FROM histogram WHERE covB < 500",
    "self_revcomp_pairs": f"WITH {_PAIRS} SELECT * FROM pairs WHERE {_RC.format('kmer_a')} = kmer_b",
    "neighbours_of_frequent": f"""WITH {_PAIRS}, ends AS (SELECT kmer_a AS kmer, kmer_b AS other, count_a AS count, count_b AS other_count, pos FROM pairs UNION ALL SELECT kmer_b, kmer_a, count_b, count_a, pos FROM pairs)
        SELECT * FROM ends WHERE count >= {OFTEN}""",
    "pairs_by_composition": f"WITH {_UNIQUE} SELECT * FROM uniq WHERE least(" + ", ".join(f"{K} - len(replace(kmer_a, '{b}', ''))" for b in "acgt") + f") = {RAREST}",
    "unique_pairs_long": f"WITH {_unique_sql(LONG_K)} SELECT * FROM uniq",
    "hamming2_pairs": f"WITH {_KEPT}, {_TWO_AWAY} SELECT * FROM twos",
    "hamming3_pairs": f"""WITH {_KEPT}, parts AS (SELECT kmer, count, [substr(kmer, 1, 5), substr(kmer, 6, 5), substr(kmer, 11, 5), substr(kmer, 16)] AS q FROM kept),
        filed AS (SELECT kmer, count, q, i, q[i] AS key FROM parts, (SELECT unnest(range(1, 5)) AS i))
        SELECT DISTINCT a.kmer AS kmer_a, b.kmer AS kmer_b, a.count AS count_a, b.count AS count_b FROM filed a JOIN filed b ON a.i = b.i AND a.key = b.key AND a.kmer < b.kmer WHERE hamming(a.kmer, b.kmer) = 3""",
    "kmer_families": f"WITH RECURSIVE {_FAMILIES} SELECT * FROM families",
    "family_coverage": f"WITH RECURSIVE {_FAMILIES}, each AS (SELECT family, count(*) AS size, sum(count) AS total FROM families JOIN kept USING (kmer) GROUP BY family) SELECT size, count(*) AS n_families, sum(total)::BIGINT AS total_count FROM each GROUP BY size",
    "extract_pairs": f"""WITH {_HISTOGRAM}, named AS (SELECT covB, covA, greatest(1, round_even(covA / 2, 0))::INT || 'A' || greatest(1, round_even(covB / 2, 0))::INT || 'B' AS smudge FROM histogram),
        sided AS (SELECT *, substr(kmer_a, pos + 1, 1) AS x, substr(kmer_b, pos + 1, 1) AS y FROM uniq)
        SELECT smudge, substr(kmer_a, 1, pos) || '(' || CASE WHEN count_a >= count_b THEN x || '/' || y ELSE y || '/' || x END || ')' || substr(kmer_a, pos + 2) AS line
        FROM sided JOIN named ON covB = least(count_a, count_b) AND covA = greatest(count_a, count_b)""",
    "coverage_bins": f"WITH {_BINS} SELECT * FROM bins",
    "local_aggregation": f"WITH RECURSIVE {_clustered(False)} SELECT * FROM labelled",
    "local_aggregation_masked": f"WITH RECURSIVE {_LABELLED} SELECT * FROM labelled",
    "peak_summary": f"""WITH RECURSIVE {_LABELLED}, k AS (SELECT *, freq * 1000000::BIGINT - covA * 1000 - covB AS key FROM labelled WHERE smudge > 0)
        SELECT smudge, count(*) AS n_bins, sum(freq)::BIGINT AS size, arg_max(covA, key) AS mode_a, arg_max(covB, key) AS mode_b, max(freq) AS mode_freq FROM k GROUP BY smudge""",
    "kmer_totals": f"WITH RECURSIVE {_TOTALS} SELECT *, round(errors / total_kmers, 6) AS error_fraction FROM totals",
    "fishnet_cells": f"WITH RECURSIVE {_CELLS} SELECT cov, a, b, size FROM cells",
    "fishnet_centres": f"WITH RECURSIVE {_CELLS} SELECT cov, a, b, mode_a, mode_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, min_a, max_a, min_b, max_b FROM cells",
    "given_cells": f"""WITH RECURSIVE {_LABELLED}, given AS (SELECT s_suppkey AS name, s_suppkey * 7 % 40 AS low_b, s_suppkey * 7 % 40 + s_nationkey AS high_b, s_suppkey * 3 % 30 AS low_a FROM supplier)
        SELECT name, sum(freq)::BIGINT AS size FROM labelled JOIN given ON covB > low_b AND covB < high_b AND covA > low_a AND covA < low_a + 20 WHERE smudge <> -1 GROUP BY name""",
    "structure_table": f"WITH RECURSIVE {_NET_TABLE} SELECT * FROM found",
    "structure_table_peaks": f"WITH RECURSIVE {_PEAKS} SELECT structure, sum(size)::BIGINT AS size, round_even(sum(size) / any_value(genomic)::DOUBLE, 4) AS rel_size FROM shown, totals GROUP BY 1",
    "structure_labels": f"WITH RECURSIVE {_PEAKS} SELECT * FROM shown",
    "annotated_bins": f"WITH RECURSIVE {_PEAKS} SELECT covB, covA, freq, a::VARCHAR || 'A' || b::VARCHAR || 'B' AS smudge FROM labelled JOIN shown USING (smudge)",
    "centrality_mode": _central("abs((mode_@ - cells.cov * @) / cells.cov)"),
    "centrality_mean": _central("abs((mean_@ - cells.cov * @) / cells.cov)"),
    "centrality_theoretical_edge": _central("least(abs(mode_@ - cells.cov * (@ - 0.5::DOUBLE)), abs(cells.cov * (@ + 0.5::DOUBLE) - mode_@))"),
    "centrality_empirical_edge": _central("least(abs(max_@ - mode_@), abs(mode_@ - min_@))"),
    "coverage_grid_level1": _central("abs((mode_@ - cells.cov * @) / cells.cov)", ", ".join(map(repr, fit.grid(0, LOW, HIGH)))),
    "coverage_grid_search": _grid_sql(),
    "cutoff_lower": f"""WITH {_EVENTS}, s AS (SELECT row_number() OVER w - 1 AS place, coalesce(lag(n) OVER w >= n, true) AND coalesce(n < lead(n) OVER w, true) AS low FROM h WINDOW w AS (ORDER BY value))
        SELECT greatest(10, round_even(min(place) * 1.25::DOUBLE, 0))::INT AS cutoff FROM s WHERE low""",
    "cutoff_upper": f"""WITH {_EVENTS}, s AS (SELECT row_number() OVER (ORDER BY value) - 2 AS place, value, n FROM h), t AS (SELECT place, sum(n) OVER (ORDER BY value) / sum(n) OVER () AS share FROM s WHERE place >= 0)
        SELECT min(place) AS place FROM t WHERE share > 0.998""",
    "weighted_percentile": f"WITH {_PLOT} SELECT {_PERCENTILE.format(95, 'p')} AS value",
    "filter_cov_quantile": f"WITH {_PLOT}, f AS (SELECT * FROM p WHERE covA >= 5 AND covB >= 5) SELECT covB, covA, freq, total_pair_cov FROM f WHERE total_pair_cov < {_PERCENTILE.format(90, 'f')}",
    "relative_coverage": f"WITH {_PLOT} SELECT covB, covA, freq, total_pair_cov, round(minor_variant_rel_cov, 6) AS minor_variant_rel_cov FROM p",
    "hist_total_cov": _histogram("total_pair_cov", "greatest(1, hi - lo)"),
    "hist_relative_cov": _histogram("minor_variant_rel_cov", "60"),
    "axis_limits": f"WITH {_LIMITS} SELECT * FROM lim",
    "plot_boxes": _boxes("@"),
    "plot_boxes_log": _boxes("log10(@)"),
    "expected_structures": f"""WITH RECURSIVE {_NET_TABLE} SELECT {_SHORT} AS label, round(len(replace(structure, 'A', '')) / len(structure), 6) AS x, len(structure) * {COV}::DOUBLE AS y,
        len(replace(structure, 'A', '')) * 2 = len(structure) AS right_aligned FROM found WHERE rel_size > 0.03""",
    "rounded_cells": f"""WITH RECURSIVE {_LABELLED}, r AS (SELECT freq, greatest(round_even(covA / {COV}::DOUBLE, 0), 1)::INT AS a, covB FROM labelled WHERE smudge <> -1),
        c AS (SELECT freq, a, b FROM r, (SELECT unnest(range(1, 9))::INT AS b) WHERE covB > CASE WHEN b = 1 THEN 0 ELSE {COV}::DOUBLE * (b - 0.5::DOUBLE) END AND covB < {COV}::DOUBLE * (b + 0.5::DOUBLE))
        SELECT a, b, sum(freq)::BIGINT AS size FROM c WHERE a >= b AND a + b <= 16 GROUP BY a, b""",
    "size_labels": f"""WITH RECURSIVE {_NET_TABLE}, s AS (SELECT {_SHORT} AS label, round_even(rel_size, 2) AS size FROM found) SELECT label, size, printf('%.2f', size) || '   ' || rpad(label, 6, ' ') AS line FROM s WHERE size >= 0.03""",
    "legend_ticks": _legend("top * x[tick + 1] / 6"),
    "legend_ticks_log": _legend("pow(10::DOUBLE, log10(top) * x[tick + 1] / 6)"),
    "iso_grid_lines": f"""WITH {_PLOT}, low AS (SELECT min(covB)::DOUBLE AS l, max(total_pair_cov)::DOUBLE AS top FROM p), t AS (SELECT unnest(range(0, 500))::INT AS step), i AS (SELECT unnest(range(0, 16))::INT AS i),
        a AS (SELECT i, step, (i + 0.5::DOUBLE) * {COV} AS mid, l + ((i + 0.5::DOUBLE) * {COV} - l) * step / 499::DOUBLE AS b FROM low, t, i),
        b AS (SELECT i, step, (i + 0.5::DOUBLE) * {COV} AS mid, 2 * (i + 0.5::DOUBLE) * {COV} - 2 + (120 - (2 * (i + 0.5::DOUBLE) * {COV} - 2)) * step / 499::DOUBLE AS y FROM t, i WHERE i < 8),
        e AS (SELECT step, l, 2 * l - 2 + (top - (2 * l - 2)) * step / 499::DOUBLE AS y FROM low, t)
        SELECT 'A' AS kind, i + 0.5::DOUBLE AS copies, step, round(b / (b + mid), 6) AS x, round(b + mid, 6) AS y FROM a WHERE b + mid < 120
        UNION ALL SELECT 'B', i + 0.5::DOUBLE, step, round(mid / y, 6), round(y, 6) FROM b
        UNION ALL SELECT 'error', 0, step, round((l - 1) / y, 6), round(y, 6) FROM e WHERE y <> 0""",
    "grid_labels": f"""WITH {_BINS}, low AS (SELECT min(covB)::DOUBLE AS l FROM bins), n AS (SELECT unnest(range(1, 1 + floor(120 / {COV})::INT))::INT AS n)
        SELECT n || 'Aerr' AS label, round(l / (n * {COV}::DOUBLE), 6) AS x, round(n * {COV}::DOUBLE + l, 6) AS y, CASE WHEN n = 1 THEN 'above' ELSE 'right' END AS side FROM low, n WHERE n < floor(120 / {COV})
        UNION ALL SELECT (n - m) || 'A' || m || 'B', round(CASE WHEN n = 2 * m THEN 0.49::DOUBLE ELSE m / n END, 6), n * {COV}::DOUBLE, CASE WHEN n = 2 * m THEN 'left' ELSE 'below' END
        FROM n, (SELECT unnest(range(1, 1 + floor(60 / {COV})::INT))::INT AS m) WHERE n >= 2 AND m <= n // 2""",
    "five_numbers": f"""WITH RECURSIVE {_LABELLED} SELECT smudge, count(*) AS n_bins, min(freq) AS least, quantile_disc(freq, 0.25) AS lower, quantile_disc(freq, 0.5) AS middle, quantile_disc(freq, 0.75) AS upper, max(freq) AS most
        FROM labelled WHERE smudge <> -1 GROUP BY smudge""",
    "peak_coverages": f"""WITH RECURSIVE {_LABELLED}, m AS (SELECT smudge, unnest(['total_pair_cov', 'minor_variant_rel_cov']) AS measure, unnest([(covA + covB)::DOUBLE, covB / (covA + covB)]) AS x FROM labelled WHERE smudge <> -1)
        SELECT smudge, measure, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS lower, round(quantile_cont(x, 0.5), 6) AS middle, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.75), 6) AS upper, round(max(x), 6) AS most
        FROM m GROUP BY smudge, measure""",
    "peak_map": f"WITH RECURSIVE {_LABELLED} SELECT round(covB / (covA + covB), 6) AS x, covA + covB AS y, smudge, CASE WHEN smudge > 0 THEN (smudge - 1) % 8 + 1 ELSE 0 END::INT AS colour FROM labelled WHERE smudge <> -1",
    "square_bins": _squares("covA", "covB"),
    "square_bins_relative": _squares("minor_variant_rel_cov", "total_pair_cov"),
    "plot_title": f"WITH RECURSIVE {_TOTALS} SELECT printf('%s%s1n = %.0f%serr = %.2f%%', 'lines', chr(10), {COV}::DOUBLE, chr(10), 100 * errors / total_kmers) AS title FROM totals",
    "report_wide": _wide(),
    "stored_bins": f"WITH {_BINS} SELECT * FROM bins WHERE covB < 500 AND freq > 0",
    "stored_sizes": f"WITH RECURSIVE {_NET_TABLE} SELECT * FROM found",
    "stored_histogram": f"WITH {_EVENTS} SELECT value, n FROM h",
    "stored_annotated": f"WITH RECURSIVE {_PEAKS} SELECT covB, covA, freq, a::VARCHAR || 'A' || b::VARCHAR || 'B' AS smudge FROM labelled JOIN shown USING (smudge) WHERE a >= b AND b > 0",
    "stored_centralities": f"SELECT round(cov, 4) AS cov, round(centrality, 4) AS centrality FROM ({_central('abs((mode_@ - cells.cov * @) / cells.cov)', ', '.join(map(repr, fit.grid(0, LOW, HIGH))))})",
    "stored_report": _wide(),
    "stored_spectrum": f"WITH {_SPECTRUM} SELECT greatest(2, least(6, multiplicity)) AS multiplicity, sum(n_unique)::BIGINT AS n_unique, sum(n_instances)::BIGINT AS n_instances FROM spectrum GROUP BY 1",
    "stored_kmer_table": f"WITH {_KEPT} SELECT kmer, count, row_number() OVER (ORDER BY kmer) - 1 AS ordinal FROM kept",
    "stored_profiles": f"WITH {_KEPT}, p AS (SELECT read_id, string_agg(coalesce(count, 0)::VARCHAR, ',' ORDER BY spot) AS profile FROM occ LEFT JOIN kept ON kept.kmer = least(occ.kmer, {_RC.format('occ.kmer')}) GROUP BY read_id) SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, profile FROM p",
    "streaming_kmer_count": f"WITH {_COUNTED} SELECT * FROM counted",
}
SQL["stored_pair_text"] = SQL["extract_pairs"]
