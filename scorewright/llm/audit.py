"""How filters interact: what each removes, by the order in which they are applied.

Documents become cells first: one for each part of the table and set of filters that its documents fail, with the
number of documents, good and toxic ones. Cells are then unpivoted against the steps of every order, so that a row is
(part, set, order, step). A window over the earlier steps of its order, by bitwise or, tells which failures came before;
conditional sums give the counts of a step, and a total over all orders the removals of a filter at any step.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.shared import prepare, texts_of

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOL = re.compile(rb"[#$%&*|]")
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
_SEGMENT = 1 << 20
_MEASURES = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("key", pa.binary()), ("n_chars", pa.int64()), ("n_words", pa.int64()), ("n_distinct", pa.int64()), ("n_capitals", pa.int64()), ("has_symbol", pa.bool_())])
_MEASURES_SQL = "doc_id long, part string, key binary, n_chars long, n_words long, n_distinct long, n_capitals long, has_symbol boolean"

#: Failure conditions over the measures of a text, by letter; the duplicate filter comes after them.
FILTERS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "has_symbol",
}
DUPLICATE = "E"


def _words(data: bytes) -> tuple[int, int]:
    """(words, different words) of a text; bytes.split() splits at the white space that _WHITE has."""
    n, seen, at = 0, set(), 0
    while at < len(data):
        cut = _WHITE.search(data, at + _SEGMENT) if at + _SEGMENT < len(data) else None
        to = cut.start() if cut else len(data)
        words = data[at:to].split()
        n += len(words)
        seen.update(words)
        at = to + 1
    return n, len(seen)


def measures(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, key, n_chars, n_words, n_distinct, n_capitals, has_symbol) of each row; key is the text's SHA-256."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = texts_of(b, "text")
            data = [t.encode() for t in texts]
            words = [_words(d) for d in data]
            columns = [
                pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([n for n, _ in words], pa.int64()),
                pa.array([n for _, n in words], pa.int64()),
                pa.array([len(d) - len(d.translate(None, _CAPITALS)) for d in data], pa.int64()),
                pa.array([bool(_SYMBOL.search(d)) for d in data], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], schema=_MEASURES)

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _MEASURES_SQL)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, str] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of a part that fail exactly the filters of the mask's bits.

    The bit after those of `filters` is the duplicate's: a document fails it if a smaller doc_id has the same text. Counts
    are summed by text, part and labels before texts meet, so that a text which many documents share costs a row for
    each part, not for each document. Labels of a doc_id that has several are joined by their maximum.
    """
    filters = FILTERS if filters is None else filters
    mask = sum((F.when(F.expr(rule), 1 << k).otherwise(0) for k, rule in enumerate(filters.values())), F.lit(0))
    rows = measures(docs, part).select("doc_id", "part", "key", mask.alias("mask"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").withColumn("good", F.coalesce(F.col("quality") == 1, F.lit(False))).withColumn("bad", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    same = ["key", "part", "mask", "good", "bad"]
    alike = marked.groupBy("doc_id", *same).agg(F.count("*").alias("n"))  # rows that repeat a doc_id count as one first
    first = F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id")
    by_text = alike.groupBy(*same).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), first.alias("n_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    lowest = F.min("low").over(Window.partitionBy("key"))
    split = by_text.withColumn("passed", F.col("n_null") + F.when(F.col("low") == lowest, F.col("n_low")).otherwise(0))
    bit = 1 << len(filters)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passed").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    out = split.select("part", "good", "bad", F.explode(both).alias("c")).where("c.n > 0")
    count = lambda on: F.sum(F.when(on, F.col("c.n")).otherwise(0))
    return out.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count(F.col("good")).alias("good"), count(F.col("bad")).alias("toxic"))


def by_order(found: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    order of the filters, whose bits in a mask follow `letters`. A part has all its steps, since it has a cell."""
    orders = ["".join(p) for p in itertools.permutations(letters)]
    steps = F.posexplode(F.split("filter_order", "")).alias("at", "filter")
    long = found.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", steps)
    bit = F.lit(None).cast("int")
    for k, letter in enumerate(letters):
        bit = F.when(F.col("filter") == letter, F.lit(1 << k)).otherwise(bit)
    long = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(of: str, on: Column) -> Column:
        return F.sum(F.when(on, F.col(of)).otherwise(0))

    counts = long.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, str] | None = None) -> DataFrame:
    """The rows of `by_order` for docs (doc_id, text, part) and labels (doc_id, quality, toxic).

    A null text is empty and a null part an empty name. Rows without a doc_id are duplicates of none and none is theirs;
    they have no labels. Rows that repeat a doc_id and text all pass the duplicate filter if that id is the smallest.
    Labels of ids that docs lacks change nothing, other columns neither, whatever their names; texts of any length are
    read whole, and an empty table gives no rows. Texts with the same SHA-256 count as identical.
    """
    filters = FILTERS if filters is None else filters
    return by_order(cells(docs, labels, part, filters), "".join(filters) + DUPLICATE)
