"""Ranked lexical search: documents as bags over the vocabulary of the items, each different bag scored once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from hetspark.llm.common import named, settled

#: Documents of an item's list (a fixed value of the ranking, as the numbers in `Totals` are).
BEST = 20
#: Items are taken in blocks of so many, and of so many terms with repeats (or one item): what is broadcast is bounded.
ITEMS, TERMS = 1024, 1 << 20
#: Cells of the two matrices that a task multiplies at a time, which bounds memory only.
CELLS = 1 << 21

#: What stands between terms, and capitals, by byte; bytes of other letters than ASCII's are parts of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters (as small ones), digits and everything beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Items:
    """A block of items: ids, places of its terms in a sorted vocabulary, and how often each item has each term."""

    ids: list
    vocabulary: list[bytes]
    row: np.ndarray  # item of each (item, term)
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, list[bytes]]]) -> Items:
        vocabulary = sorted({t for _, ts in rows for t in ts})
        place = {t: i for i, t in enumerate(vocabulary)}
        key = np.array([r * len(vocabulary) + place[t] for r, (_, ts) in enumerate(rows) for t in ts], np.int64)
        key, times = np.unique(key, return_counts=True)
        width = max(1, len(vocabulary))
        return cls([i for i, _ in rows], vocabulary, key // width, key % width, times)


@dataclass
class Totals:
    """Documents that have a term, terms of all of them with repeats, weights of the vocabulary."""

    documents: int
    length: int
    weight: np.ndarray

    def norm(self) -> Column:
        """m of documents of n terms."""
        return F.expr(f"75L + (25L * n * {self.documents}L) div {max(1, self.length)}L")


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks, read by the driver one block at a time."""
    rows, held = [], 0
    for r in items.select(named(items, item_col).alias("item_id"), named(items, text_col).alias("text")).toLocalIterator():
        rows.append((r.item_id, terms(r.text)))
        held += len(rows[-1][1])
        if len(rows) == ITEMS or held >= TERMS:
            yield Items.of(rows)
            rows, held = [], 0
    if rows:
        yield Items.of(rows)


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, bag): the number of all terms of a document, and those of the vocabulary in it as packed().

    Whole texts are cut, about CELLS bytes at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, held, found, sizes = at, 0, [], []
                while to < len(texts) and held < CELLS:
                    words = terms(texts[to])
                    sizes.append(len(words))
                    found.append(np.array([p for p in map(place.get, words) if p is not None], np.int64) + (to - at) * width)
                    held += 8 * len(words) + 1
                    to += 1
                key, times = np.unique(np.concatenate(found), return_counts=True)
                bounds = np.searchsorted(key, np.arange(to - at + 1) * width)
                made = [packed(key[a:b] % width, times[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n", "bag"])
                at = to

    rows = docs.select(named(docs, id_col).cast("bigint").alias("doc_id"), named(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def packed(term: np.ndarray, times: np.ndarray) -> bytes:
    """Terms in rising order, and how often each one occurs: a byte each, or for any number over 254 a 255 and, after all
    the bytes, eight more. Equal bags, and only these, have equal bytes."""
    over = times > 254
    return b"".join((np.int32(len(term)).tobytes(), term.astype("<i4").tobytes(), np.where(over, 255, times).astype(np.uint8).tobytes(), times[over].astype("<i8").tobytes()))


def unpacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bag, term, times) of all bags together."""
    sizes, ts, ns = [], [], []
    for bag in bags:
        k = int.from_bytes(bag[:4], "little")
        term, n = np.frombuffer(bag, "<i4", k, 4), np.frombuffer(bag, np.uint8, k, 4 + 4 * k).astype(np.int64)
        if len(bag) > 4 + 5 * k:
            n[n == 255] = np.frombuffer(bag, "<i8", -1, 4 + 5 * k)
        sizes.append(k)
        ts.append(term)
        ns.append(n)
    return np.repeat(np.arange(len(bags)), sizes), np.concatenate([np.zeros(0, np.int32), *ts]), np.concatenate([np.zeros(0, np.int64), *ns])


def totals(bags: DataFrame, size: int) -> Totals:
    """Over all documents. A task sends the number of documents of each term that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(unpacked(batch.column(0).to_pylist())[1], minlength=size)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(df[met], pa.int64())], ["term", "df"])

    each = bags.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(size, np.int64)
    for r in bags.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
        df[r.term] = r.df
    return Totals(each.documents, each.length, np.array([math.floor(1000 * math.log((2 * each.documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64))


def classes(bags: DataFrame, totals: Totals) -> DataFrame:
    """(bag, m, members): documents of equal bags and m, as the BEST smallest of their ids (repeats included).

    Rows meet by the hash of both, and by both themselves, so that no two classes mix. Each task sends BEST rows of a
    class at most, whatever the number of copies. Bags without a term of the vocabulary score 0 and are left out.
    """
    rows = bags.where(F.length("bag") > 4).select("doc_id", "bag", totals.norm().alias("m"))
    rows = rows.withColumn("hash", F.xxhash64("bag", "m"))
    first = W.Window.partitionBy("hash", "bag", "m").orderBy(F.asc_nulls_first("doc_id"))
    kept = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= BEST)
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])
    return kept.groupBy("hash", "bag", "m").agg(members.alias("members")).select("bag", "m", "members")


class Scorer:
    """Scores of classes for a block of items, and the best documents so far of each item."""

    def __init__(self, items: Items, totals: Totals):
        self.items, self.weight = items, totals.weight
        self.n, self.width = len(items.ids), len(items.vocabulary)
        times = np.bincount(items.row, weights=items.times, minlength=self.n)
        # A term adds weight * 10^6 at most: products of doubles are exact below 2^53, beyond it whole numbers are used.
        self.exact = times.max(initial=0) * 1_000_000 * self.weight.max(initial=0) < 2**53
        self.kind = np.float64 if self.exact else np.int64
        self.asked = np.zeros((self.width, self.n), self.kind)
        self.asked[items.term, items.row] = items.times
        self.step = max(1, CELLS // max(self.width, self.n))
        self.best = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, null-first order of ids, id

    def add(self, bags: list[bytes], m: np.ndarray, members: list[list[int | None]]) -> None:
        for at in range(0, len(bags), self.step):
            self._add(bags[at : at + self.step], m[at : at + self.step], members[at : at + self.step])

    def _add(self, bags: list[bytes], m: np.ndarray, members: list[list[int | None]]) -> None:
        of, term, times = unpacked(bags)
        x = np.zeros((len(bags), self.width), self.kind)
        x[of, term] = self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[of]))
        scores = (x @ self.asked).astype(np.int64)
        least = np.ones(self.n, np.int64)
        item, score = self.best[:2]
        full = np.flatnonzero(np.bincount(item, minlength=self.n) >= BEST)
        worst = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(worst, item, score)
        least[full] = np.maximum(1, worst[full])
        if len(bags) > BEST:  # of these classes alone, BEST have this score at least
            least = np.maximum(least, np.partition(scores, len(bags) - BEST, 0)[len(bags) - BEST])
        c, i = np.nonzero(scores >= least)
        sizes = np.array([len(x) for x in members], np.int64)
        docs = [d for x in members for d in x]
        begin, held = np.cumsum(sizes) - sizes, sizes[c]
        at = np.repeat(begin[c], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        known = np.array([d is not None for d in docs], np.int64)
        ids = np.array([d or 0 for d in docs], np.int64)
        new = [np.repeat(i, held), np.repeat(scores[c, i], held), known[at], ids[at]]
        item, score, known, ids = (np.r_[a, b] for a, b in zip(self.best, new, strict=True))
        order = np.lexsort((ids, known, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.best = [x[order][place < BEST] for x in (item, score, known, ids)]
        self.best[0] = item[place < BEST]

    def rows(self) -> pa.RecordBatch:
        item, score, known, ids = self.best
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=known == 0)], ["item", "score", "doc_id"])


def ranked(classes: DataFrame, items: Items, totals: Totals) -> DataFrame:
    """(item, rank, doc_id, score) for a block: each task keeps the best documents of each item among its classes; the
    best of these stay. A class's members come in the order of their ids, so BEST of them are enough."""
    shared = classes.sparkSession.sparkContext.broadcast((items, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            if len(batch):
                scorer.add(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist())
        yield scorer.rows()

    found = classes.mapInArrow(run, "item bigint, score bigint, doc_id bigint")
    order = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the BEST documents of each item, highest score first, equal ones by rising id.

    Items are a stated set of questions and are taken in blocks (ITEMS, TERMS), each against all documents. A document
    is reduced to its bag over the terms of the block and its length; documents that agree in both score alike, so each
    class of them is scored once, by a product of matrices of whole numbers.

    Defined cases: null texts have no terms. Documents without a term count in no total. Items without terms, or whose
    terms no document has, have no rows; items that share an id are ranked each on its own. Null document ids come
    first among equals; repeated rows are documents of their own. Very long texts count whole. Empty tables give an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = items.select(named(items, item_col).alias("item_id")).schema["item_id"]
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        reduced = settled(bags(docs, block.vocabulary, id_col, text_col))
        total = totals(reduced, len(block.vocabulary))
        found = ranked(classes(reduced, total), block, total)
        names = spark.createDataFrame([*enumerate(block.ids)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind.dataType)]))  # ITEMS rows at most
        rows = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.range(0).select(F.lit(None).cast(kind.dataType).alias("item_id"), F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    return out


def search_sql() -> str:
    """search() for DuckDB, over tables documents and benchmark."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
        WITH words AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS words FROM documents
        ), sized AS (SELECT r, doc_id, len(words)::BIGINT AS n FROM words WHERE len(words) > 0
        ), total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized
        ), tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM words) GROUP BY r, term
        ), asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({cut}) AS term FROM benchmark) GROUP BY item_id, term
        ), weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs
        ), scored AS (
            SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
            FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN sized USING (r), total GROUP BY item_id, doc_id, r
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20"""
