import hashlib
import random

from hetspark.llm import dedup

ROWS = [(1, "a b", "s"), (2, "a b", "t"), (3, None, "s"), (4, "", None), (5, "A b", "s"), (None, "z", "s"), (None, "q", "s"), (7, "z", "s"), (8, "x" * 300_000, "s"), (9, "x" * 300_000, "s"), (10, "é\n", "s"), (10, "é\n", "s")]


def test_groups(make):
    got = {(r.doc_id, r.text_sha256): r for r in dedup.exact_groups(make(ROWS)).collect()}
    by = {r[0]: v for r in ROWS for k, v in got.items() if k[0] == r[0] and r[0]}
    assert [by[i].keep_id for i in (1, 2, 3, 4, 5, 7, 8, 9, 10)] == [2, 2, 4, 4, 5, 7, 9, 9, 10]
    assert [by[i].group_size for i in (1, 3, 5, 7, 8, 10)] == [2, 2, 1, 2, 2, 2]
    assert [by[i].kept for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert {v.kept for k, v in got.items() if k[0] is None} == {True, False}
    assert dedup.exact_groups(make(ROWS)).count() == len(ROWS)


def test_dropping(make):
    out = dedup.drop_copies(make(ROWS))
    assert out.columns == make(ROWS).columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 4, 5, 7, 9, 10]


def test_clashing_names_and_string_ids(make):
    df = make(ROWS)
    for name in ("__id", "__digest", "__none", "id", "kept", "text_sha256"):
        df = df.withColumn(name, df["n_chars"].isNull().cast("int") + 4)
    out = dedup.drop_copies(df)
    assert out.columns == df.columns and {r["__digest"] for r in out.collect()} == {5} and out.count() == 7
    ids = make([(1, "same", "~"), (2, "same", None), (3, "same", "b"), (4, "lone", None), (5, "lone", None)]).drop("doc_id").withColumnRenamed("source", "doc_id")
    assert sorted((r.doc_id or "", r.text) for r in dedup.drop_copies(ids).collect()) == [("", "lone"), ("~", "same")]


def test_against_brute_force(make):
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "a", "A", "a ", "é", "b" * 1000]), "s") for _ in range(300)]
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in dedup.exact_groups(make(rows)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if (u or "") == (t or "")]
        top = max((j for j in same if j is not None), default=None)
        want.append((i, top, len(same), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty(make):
    assert dedup.exact_groups(make([])).count() == 0 and dedup.drop_copies(make([])).count() == 0


def test_native(make):
    plan = dedup.exact_groups(make(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_a_third_of_all_rows_null_in_id_and_equal_in_text(spark):
    """Rows equal in id and text are dropped before anything is shuffled by them."""
    rows = [(None, "the same")] * 3000 + [(i, f"text {i % 2000}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    out = dedup.drop_copies(docs)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(None, "the same"), *((i, f"text {i % 2000}") for i in range(4000, 6000))], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Aggregate"), "repeated rows go below the join"
