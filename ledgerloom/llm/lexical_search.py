"""Ranked lexical search by TPUT over postings that are partitioned by term.

A term is a maximal run of letters, digits and anything beyond ASCII, with A to Z lowered. Each item's documents are ranked by a sum
over its distinct terms of integer impacts (``impact``). Three phases read the lists, never a whole document again:

1. The head of each term's list, its k largest impacts, names documents for each item. The few with the largest sums over the heads are
   looked up; the k-th best of their scores is a lower bound of the item's k-th best score.
2. Every list of an item is cut at one threshold, below which documents that are in no cut list can't reach the bound, given that
   no list has more than its head's first impact. The sums of what is read give each document an upper bound. At the largest such
   threshold (``SHARE`` of 1) every document that is read at all could still reach the bound; a lower one reads a little more and
   leaves few.
3. Documents whose upper bound reaches the lower one are looked up exactly.

All bounds are integers and a document equal to a bound stays, so ties are decided by exact scores alone.

Scale: texts are split once. Only postings of the items' terms are kept. They lie by term within slices of documents, those of a
task, so a common term's list is spread over all slices, and a task sums up an item's impacts for a document before anything is
shuffled: with lists that were whole by term, 220 million partial sums of 0.5 GB of documents met in one shuffle. Heads and bounds
are limited within tasks, too. Documents to look up are broadcast where they were counted and are few, and joined by key otherwise.

Edge cases: a null text has no terms; a document or item without terms takes no part. Each row is a document or item of its
own, whatever ids repeat; equal scores go by doc_id, nulls last, then by the order of rows read. Whole texts are read, however long. An
empty table of either kind gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.scratch import written

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: No term is empty: the empty string marks one row for each document, which carries its length.
DOCUMENT = ""
#: Rows of a written table, of some 50 bytes each, that are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 500_000
#: The threshold as a share of the largest one.
SHARE = 0.3


def terms_in(text: str | None) -> list[bytes]:
    """All terms of a text, with repeats, in order."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def _counted(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(key, id, n, term, tf): a row for each distinct term of each text, and one for the empty term where a text has any; n counts all its terms."""
    source = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    lists = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("key", T.LongType()), source.schema["id"], T.StructField("n", T.LongType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sizes, ends, terms, tfs = [], [0], [], []
                for text in part.column(1).to_pylist():
                    found = terms_in(text)
                    counts = Counter(found)
                    if found:
                        counts[DOCUMENT.encode()] = 1
                    sizes.append(len(found))
                    terms += counts.keys()
                    tfs += counts.values()
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                keys = pa.array(range(key, key + len(sizes)), pa.int64())
                key += len(sizes)
                columns = [keys, part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    each = source.mapInArrow(run, schema).select("key", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return each.select("key", "id", "n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def impact(weight: Column, tf: Column, n: Column, documents: int, terms: int) -> Column:
    """What a term adds to the score of a document of n terms that holds it tf times."""
    m = F.lit(10) + F.call_function("div", F.lit(90 * documents) * n, F.lit(max(terms, 1)))
    return weight * F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * m)


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it was counted and is small: so lists stay where they lie."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _best(sums: DataFrame, k: int, value: str) -> DataFrame:
    """The k rows of each item with the largest ``value``."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value), "key"))
    return sums.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _looked_up(scored: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, key, doc_id, score): exact scores of documents for items."""
    wanted = written(pairs.select("item", "key"), "search-documents")
    near = scored.join(_sent(wanted), "key")
    return near.join(_sent(asked.select("item", "term")), ["item", "term"]).groupBy("item", "key", "doc_id").agg(F.sum("impact").alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    asked = written(_counted(items, item_id, item_text).select(F.col("key").alias("item"), F.col("id").alias("item_id"), "term").filter(F.col("term") != DOCUMENT), "search-terms")
    wanted = written(asked.select("term").distinct().unionByName(spark.range(1).select(F.lit(DOCUMENT).alias("term"))), "search-wanted")
    kept = _counted(docs, doc_id, text).withColumnRenamed("id", "doc_id").join(_sent(wanted), "term", "left_semi")
    lists = written(kept.sortWithinPartitions("term"), "search-lists")
    totals = lists.filter(F.col("term") == DOCUMENT).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"]
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * documents + 2) / (F.lit(2) * F.col("df") + 1)))
    weights = written(lists.filter(F.col("term") != DOCUMENT).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("weight")), "search-weights")
    scored = lists.join(_sent(weights), "term").select("term", "key", "doc_id", impact(F.col("weight"), F.col("tf"), F.col("n"), documents, terms).alias("impact")).filter("impact > 0")

    head = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "key"))
    heads = written(scored.withColumn("place", head).filter(F.col("place") <= k), "search-heads")
    sums = heads.join(asked.select("item", "term"), "term").groupBy("item", "key").agg(F.sum("impact").alias("partial"))
    tried = _looked_up(scored, _best(sums, 3 * k, "partial"), asked)
    bound = _best(tried, k, "score").groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    # No list has more than ``most``. Of x = (bound - 1 - what the j shortest lists can give) / (the number of others), the largest is
    # the level at which the lists together stay below the bound; so they do at a share of it.
    most = heads.groupBy("term").agg(F.max("impact").alias("most"))
    lists_of = asked.join(most, "term").join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    shorter = Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("item")
    others = F.count("*").over(whole) - F.count("*").over(shorter)
    level = F.call_function("div", F.col("bound") - 1 - F.coalesce(F.sum("most").over(shorter), F.lit(0)), others)
    lists_of = lists_of.withColumn("x", level).withColumn("level", F.floor(F.greatest(F.max("x").over(whole), F.lit(0)) * SHARE))
    lists_of = lists_of.withColumn("cap", F.least("level", "most"))
    cuts = written(lists_of.withColumn("all_caps", F.sum("cap").over(whole)).select("item", "term", "level", "cap", "all_caps", "bound", "most"), "search-cuts")

    read = scored.join(_sent(cuts.filter("most > level")), "term").filter("impact > level")
    upper = F.sum(F.col("impact") - F.col("cap")) + F.max("all_caps")
    candidates = read.groupBy("item", "key").agg(upper.alias("upper"), F.max("bound").alias("bound")).filter(F.col("upper") >= F.col("bound"))
    exact = _looked_up(scored, candidates, asked).join(asked.select("item", "item_id").distinct(), "item")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
