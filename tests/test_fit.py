import random
from collections import defaultdict

import numpy as np
import pytest

from hetspark.operators import cluster, fit, report

BINS = "covB int, covA int, freq bigint"
F6 = [(5, 40, 5000), (20, 20, 4000), (20, 21, 3000), (20, 40, 2500), (7, 40, 2000), (30, 60, 900)]


def looks(b, a, d):
    """What a bin looks at, by the closed form."""
    for x in range(a - d, a + d + 1):
        r = d - abs(a - x)
        yield from ((x, v) if v <= x else (v, x) if v == b - r else (v, v - 1) for v in range(b - r, b + r + 1))


def ascent(rows, d, noise, mask):
    """Bins one by one in order of falling freq; each joins the best of those before it that it looks at."""
    edge = min(r[0] for r in rows) + d if mask else -1
    done, peaks = {}, 0
    for b, a, f in sorted((r for r in rows if r[2] >= noise), key=lambda r: (-r[2], r[0] + r[1], r[0])):
        met = [done[x] for x in looks(b, a, d) if x in done] if b >= edge else [(0, -1)]
        if not met:
            peaks += 1
            met = [(0, peaks)]
        done[a, b] = (f, max(met, key=lambda m: m[0])[1])
    return {(b, a): done.get((a, b), (0, 0))[1] for b, a, _ in rows}


def labels(spark, rows, *how):
    return {(r.covB, r.covA): r.smudge for r in cluster.local_aggregation(spark.createDataFrame(rows, BINS), *how).collect()}


def test_worked_example(spark):
    out = cluster.local_aggregation(spark.createDataFrame(F6, BINS), 2, 1000, True)
    assert {(r.covB, r.covA): r.smudge for r in out.collect()} == {(5, 40): -1, (20, 20): 1, (20, 21): 1, (20, 40): 2, (7, 40): -1, (30, 60): 0}
    t = cluster.totals(out).first()
    assert (t.total_kmers, t.genomic, t.in_peaks, t.errors) == (17400, 10400, 9500, 7000)
    sizes = {(r.a, r.b): r for r in fit.cells(out, [20.0], t.genomic).collect()}
    assert {k: r["size"] for k, r in sizes.items()} == {(1, 1): 7000, (2, 1): 2500}
    assert fit.centrality(fit.cells(out, [20.0], t.genomic), [20.0]).first().centrality == 0
    table = report.structure_table(fit.label_peaks(out, 20.0, t.genomic), t.genomic)
    assert {r.structure: (r["size"], r.rel_size) for r in table.collect()} == {"AB": (7000, 0.6731), "AAB": (2500, 0.2404)}


@pytest.mark.parametrize("seed", range(4))
def test_against_the_sequential_form(spark, seed):
    r = random.Random(seed)
    where = {(min(x), max(x)) for x in ((r.randint(1, 25), r.randint(1, 25)) for _ in range(200))}
    rows = [(b, a, r.randint(1, 12)) for b, a in where]
    d, mask = r.choice([1, 2, 5]), bool(seed % 2)
    assert labels(spark, rows, d, 3, mask) == ascent(rows, d, 3, mask)


def slow_search(rows, low, high):
    total = sum(f for _, _, f, s in rows if s != -1)

    def at(cov):
        cells = defaultdict(list)
        for b, a, f, s in rows:
            if s == -1:
                continue
            for nb in range(1, 9):
                for na in range(nb, 17 - nb):
                    inside = lambda n, v: (0 if n == 1 else cov * (n - 0.5)) < v < cov * (n + 0.5)
                    if inside(nb, b) and inside(na, a):
                        cells[na, nb].append((f, -a, -b))
        if not cells:
            return 1.0
        parts = [(abs(-max(c)[1] - cov * na) / cov + abs(-max(c)[2] - cov * nb) / cov, sum(f for f, _, _ in c)) for (na, nb), c in cells.items() if sum(f for f, _, _ in c) / total > 0]
        return sum(x * w for x, w in parts) / sum(w for _, w in parts)

    for start, end, step in fit.GRIDS:
        covs = np.arange(int(low) + start, int(high) + end, step).tolist()
        values = [at(c) for c in covs]
        best = low = high = covs[int(np.argmin(values))]
    return best / 2 if at(best / 2) < min(values) else best


def test_grid_search(spark):
    r = random.Random(5)
    bins = {}
    for _ in range(3000):
        n = r.choice([(1, 1), (1, 1), (1, 2), (2, 2), (1, 3)])
        b, a = sorted(max(1, round(r.gauss(18.3 * x, 2.5))) for x in n)
        bins[b, a] = bins.get((b, a), 0) + 1
    rows = [(b, a, f, 0) for (b, a), f in bins.items()]
    labelled = spark.createDataFrame(rows, BINS + ", smudge int")
    best, tested = fit.grid_search(labelled, sum(f for _, _, f, _ in rows), 6, 40)
    assert best == pytest.approx(slow_search(rows, 6, 40), abs=1e-9) and 15 < best < 21
    assert {r.level for r in tested.select("level").distinct().collect()} == {1, 2, 3}


def test_without_cells_or_coverage(spark):
    labelled = spark.createDataFrame([(5, 5, 3, -1)], BINS + ", smudge int")
    assert fit.centrality(fit.cells(labelled, [7.0], 1), [7.0]).first().centrality == 1
    assert fit.label_peaks(labelled, 0.0, 0).count() == 0 and fit.coverage_or_zero(17.0, 0.7) == 0 and fit.coverage_or_zero(17.0, 0.69) == 17
    empty = report.wide_report(report.structure_table(fit.label_peaks(labelled, 0.0, 0), 0), cluster.totals(labelled), "x").first()
    assert empty.total_error_kmers == 3 and empty["AB"] == 0 and len(empty) == 3 + 256


@pytest.mark.parametrize("heights, want", [([9, 5, 3, 6, 8], 10), ([*range(20, 7, -1), 30], 15), ([*range(20, 9, -1), 30], 12)])
def test_lower_cutoff(spark, heights, want):
    assert fit.cutoff_lower(spark.createDataFrame(list(enumerate(heights, 1)), "value bigint, n bigint")).first().cutoff == want


def test_small_things(spark):
    assert [fit.rounded_up(x) for x in (137, 7, 1000, 1)] == [140, 7, 1000, 1.0]
    assert report.report_labels()[:4] == ["AB", "AAB", "AAAB", "AABB"] and "3A2B" in report.report_labels() and len(report.report_labels()) == 256
    ramp = lambda *how: [r.colour for r in report.colour_ramp(spark, *how).orderBy("step").collect()]
    assert ramp(32, 16)[:18] == [0] * 17 + [1] and ramp() == list(range(32))
    tops = spark.createDataFrame([(1, 2, 6000)], "covB int, covA int, freq bigint")
    assert [r.value for r in report.legend_ticks(tops).orderBy("tick").collect()] == [0, 1000, 2000, 3000, 4000, 5000, 6000]
    assert report.titles(spark.createDataFrame([(0.1234,)], "error_fraction double"), "x", 18.4).first().title == "x\n1n = 18\nerr = 12.34%"


def test_weighted_percentile_is_numpys(spark):
    r = np.random.default_rng(1)
    x, w = r.integers(1, 60, 300), r.integers(1, 9, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, w, strict=True)], "x int, w int")
    for q in (5, 50, 95):
        assert fit.weighted_percentile(df, "x", "w", q).first().value == np.percentile(x, q, weights=w, method="inverted_cdf")


def test_grid_lines_by_hand(spark):
    bins = spark.createDataFrame([(10, 20, 5), (12, 30, 7)], "covB int, covA int, freq bigint")
    rows = {(r.kind, r.copies, r.step): (round(r.x, 6), round(r.y, 6)) for r in report.iso_lines(bins, 20.0, 100).collect()}
    assert {rows["A", 0.5, s] for s in range(500)} == {(0.5, 20.0)}
    assert (rows["A", 1.5, 0], rows["A", 1.5, 499]) == ((0.25, 40.0), (0.5, 60.0))
    assert ("A", 4.5, 0) not in rows and ("A", 3.5, 499) not in rows and rows["A", 3.5, 0] == (0.125, 80.0)
    assert (rows["B", 0.5, 0], rows["B", 0.5, 499]) == ((round(10 / 18, 6), 18.0), (0.1, 100.0))
    assert rows["B", 7.5, 0] == (round(150 / 298, 6), 298.0) and ("B", 8.5, 0) not in rows
    assert (rows["error", 0, 0], rows["error", 0, 499]) == ((0.5, 18.0), (round(9 / 42, 6), 42.0))


def test_grid_labels_by_hand(spark):
    bins = spark.createDataFrame([(10, 20, 5), (12, 30, 7)], "covB int, covA int, freq bigint")
    got = {r.label: (round(r.x, 6), r.y, r.side) for r in report.grid_labels(bins, 20.0, 100).collect()}
    assert got == {
        "1Aerr": (0.5, 30.0, "above"), "2Aerr": (0.25, 50.0, "right"), "3Aerr": (round(1 / 6, 6), 70.0, "right"), "4Aerr": (0.125, 90.0, "right"),
        "1A1B": (0.49, 40.0, "left"), "2A1B": (round(1 / 3, 6), 60.0, "below"), "3A1B": (0.25, 80.0, "below"), "2A2B": (0.49, 80.0, "left"), "4A1B": (0.2, 100.0, "below"), "3A2B": (0.4, 100.0, "below"),
    }


def test_palettes(spark):
    assert report.palette_colours("viridis", 9) == [f"#{c}" for c in report.PALETTES["viridis"]]
    assert report.palette_colours("grey", 3) == ["#000000", "#808080", "#ffffff"] and report.palette_colours("grey", 3, invert=True)[0] == "#ffffff"
    rows = report.colour_ramp(spark, 32, 16, "magma", True).orderBy("step").collect()
    assert len(rows) == 32 and {r.rgb for r in rows[:17]} == {"#fcfdbf"} and rows[-1].rgb == "#000004" and rows[-1].colour == 15
    with pytest.raises(ValueError, match="palettes are"):
        report.palette_colours("none", 3)
