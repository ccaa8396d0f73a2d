"""Removal of every byte covered by a 200-byte string that starts anywhere else in the corpus.

Equal strings choose equal anchors: the anchor of a 200-byte window is its 32-byte gram of least hash (the last, on ties).
So only windows that share an anchor's gram need comparing. One pass emits the anchors (about one in 85 bytes); grams
found at one place only drop out. For the others, the bytes around each anchor are brought together by gram, and the
suffixes from the anchors are put in order by deep-shallow sorting (multikey quicksort to a shallow depth, then blind
tries). Neighbours in that order give common lengths to the right, the bytes before the anchors common lengths to the
left, and both together say exactly which windows occur twice.

Equal texts are folded by digest first; a text of 200 bytes or more that occurs twice goes as a whole. The surroundings of a
gram in more than ``TOGETHER`` places are split before they are sorted: windows that begin within a range of distances before
the anchor all hold the same core of bytes around it, so only surroundings with equal cores can share such a window. A
quarter of the range makes the core longer and the group smaller; surroundings that have become equal are folded, by partial
aggregation, and groups still over ``TOGETHER`` are split again, at last into single windows, which are all core. So
every task sorts a bounded group, however frequent a gram is, and every window is compared with all its equals.

Edge cases: a null text counts as empty; texts under 200 bytes lose nothing; repeats inside one text count. Whole texts
are treated, in pieces of ``PIECE`` bytes that overlap by 199. An empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.suffix_sort import common, deep_shallow_sort
from ledgerloom.scratch import release, written

LENGTH = 200
GRAM = 32
#: So many surroundings, of under 400 bytes each, are sorted as one group; larger groups are split.
TOGETHER = 1_000
PIECE = 4_000_000

_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as far as they are needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            ones = np.ones(size, np.uint64)
            ones[1:] = np.uint64(_P)
            cls.up = np.multiply.accumulate(ones)
            ones[1:] = np.uint64(pow(_P, -1, 1 << 64))
            cls.down = np.multiply.accumulate(ones)
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of the bytes."""
    up, down = _Powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor's place, first window's start, last window's start) of the anchors of all windows."""
    found = []
    for base in range(0, max(1, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - base), base) if len(text) > base else np.empty(0, np.uint8)
        if len(data) < length:
            continue
        hashes = gram_hashes(data, gram)
        ranks = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
        span, width = 1, length - gram + 1
        while 2 * span <= width:
            ranks = np.minimum(ranks[:-span], ranks[span:])
            span *= 2
        rest = width - span
        if rest:
            ranks = np.minimum(ranks[:-rest], ranks[rest:])
        place = (_LOW - (ranks & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        at = place[first]
        found.append((hashes[at].view(np.int64), at + base, first + base, last + base))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_windows(contexts: list[tuple[bytes, bytes, int]], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each (left, right, windows) around one gram, which windows occur elsewhere, as intervals of bytes left of the anchor.

    ``left`` are the bytes from the first window's start to the anchor; ``right`` those from the anchor to the last window's end.
    Windows are named by how many bytes they start before the anchor.
    """
    places: dict[tuple[bytes, bytes, int], list[int]] = defaultdict(list)
    for i, context in enumerate(contexts):
        places[context].append(i)
    distinct = list(places)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    # Grams are grouped by hash; where two different ones meet, nothing is taken for granted.
    start = gram if len({c[1][:gram] for c in distinct}) == 1 else 0
    order, shared = deep_shallow_sort([c[1] for c in distinct], start) if len(distinct) > 1 else ([0], [start])
    for n, d in enumerate(order):
        left, right, windows = distinct[d]
        most, least = len(left), len(left) - windows + 1
        if len(places[distinct[d]]) > 1:
            spans = [(least, most)]
        else:
            spans = []
            reached = least - 1
            up, down = n - 1, n + 1
            same_up = shared[n] if n else -1
            same_down = shared[down] if down < len(order) else -1
            while reached < most:
                if same_up >= same_down:
                    same, other = same_up, up
                    up -= 1
                    same_up = min(same, shared[up + 1]) if up >= 0 else -1
                else:
                    same, other = same_down, down
                    down += 1
                    same_down = min(same, shared[down]) if down < len(order) else -1
                if length - same > most:
                    break
                theirs = distinct[order[other]][0]
                need = max(reached + 1, length - same)
                if need > min(most, len(theirs)) or left[most - need :] != theirs[len(theirs) - need :]:
                    continue
                reached = common(left[::-1], theirs[::-1], need)
                spans.append((need, min(reached, most)))
        for i in places[distinct[d]]:
            out[i] = spans
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bodies(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[], [], [], []]
                for k1, k2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _bodies(part.column(2))):
                    if text is None or len(text) < length:
                        continue
                    h, place, first, last = anchors(text, length, gram)
                    columns[0].append(h)
                    columns[1].append(np.full(len(h), k1))
                    columns[2].append(np.full(len(h), k2))
                    columns[3].append(place << 16 | (place - first) << 8 | last - first)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["h", "k1", "k2", "spot"])

    return run


def _context_rows(length: int):
    """(h, k1, k2, spot, left, right) of a text's flagged anchors."""
    names = ["h", "k1", "k2", "spot", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, text, spots = (c[0].as_py() for c in batch.slice(row, 1).columns)
                text = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(spots), 4096):
                    some = spots[at : at + 4096]
                    out: list[list] = [[], [], [], [], [], []]
                    for spot in some:
                        s = spot["spot"]
                        place, first = s >> 16, (s >> 16) - (s >> 8 & 255)
                        out[0].append(spot["h"])
                        out[3].append(s)
                        out[4].append(text[first:place])
                        out[5].append(text[place : first + (s & 255) + length])
                    out[1], out[2] = [k1] * len(some), [k2] * len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()] * 2)], names=names)

    return run


_CONTEXT = "h bigint, k1 bigint, k2 bigint, spot bigint, left binary, right binary"
_SPAN = "k1 bigint, k2 bigint, a bigint, b bigint"


def _spans_of_groups(length: int, gram: int):
    """Spans from (key, k1, k2, place, lo, hi, left, right, alone) rows that arrive sorted by key; only one key's rows are held at a time.

    Rows that stand for several equal ones aren't ``alone``: their spans are known, and they are only met by others.
    """

    def solve(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        found = repeated_windows([(left, right, hi - lo + 1) for _, _, _, lo, hi, left, right, _ in rows], length, gram)
        return [(k1, k2, place - most, place - least + length) for (k1, k2, place, _, _, _, _, alone), spans in zip(rows, found) if alone for least, most in spans]

    def batch_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made = None, [], []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if len(held) > 1:
                        made += solve(held)
                    now, held = key, []
                    if len(made) > 20_000:
                        yield batch_of(made)
                        made = []
                held.append(row)
        if len(held) > 1:
            made += solve(held)
        if made:
            yield batch_of(made)

    return run


def _cut_rows():
    """(k1, k2, n_removed, n_spans, kept_sha256) from text and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            removed, counts, digests = [], [], []
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py().encode("utf-8", "surrogatepass")
                runs = covered([(s["a"], s["b"]) for s in batch.column(3)[row].as_py() or ()])
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                removed.append(sum(b - a for a, b in runs))
                counts.append(len(runs))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=names)

    return run


def _sorted_spans(rows: DataFrame, length: int, gram: int) -> DataFrame:
    columns = ("key", "k1", "k2", "place", "lo", "hi", "left", "right", "alone")
    return rows.repartition("key").sortWithinPartitions("key").select(*columns).mapInArrow(_spans_of_groups(length, gram), _SPAN)


def _folded(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of what is equal throughout, and one row for each different surroundings of a key."""
    rows = written(rows.withColumn("digest", F.unhex(F.md5(F.concat("left", "right")))), "suffix-rows")
    by = ["key", "lo", "hi", "digest"]
    one = F.min(F.struct("k1", "k2", "place")).alias("one")
    same = written(rows.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and("alone").alias("alone"), one, F.first("left").alias("left"), F.first("right").alias("right")), "suffix-same")
    twice = rows.filter("alone").join(same.filter("n > 1").select(*by), by, "left_semi")
    spans = twice.select("k1", "k2", (F.col("place") - F.col("hi")).alias("a"), (F.col("place") - F.col("lo") + length).alias("b"))
    return spans, same.select("key", "one.*", "lo", "hi", "left", "right", (F.col("alone") & (F.col("n") == 1)).alias("alone"))


def _quarters(rows: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Rows cut to ranges of ``width`` distances, four to each range of before, with keys of their longer cores."""
    base = F.col("lo") - F.col("lo") % (4 * width)
    parts = []
    for quarter in range(4):
        first = base + quarter * width
        last = first + (width - 1)
        part = rows.withColumns({"first": first, "last": F.least(last, F.lit(length - gram)), "low": F.greatest("lo", first), "high": F.least("hi", last)}).filter("low <= high")
        left = F.substring("left", F.col("hi") - F.col("high") + 1, F.col("high"))
        right = F.substring("right", F.lit(1), length - F.col("low"))
        part = part.select("key", "k1", "k2", "place", "alone", "first", "last", "low", "high", left.alias("left"), right.alias("right"))
        core = F.concat("key", F.substring("left", F.col("high") - F.col("first") + 1, F.col("first")), F.substring("right", F.lit(1), length - F.col("last")), F.to_binary(F.lpad(F.hex("first"), 4, "0"), F.lit("hex")))
        parts.append(part.select(F.unhex(F.md5(core)).alias("key"), "k1", "k2", "place", F.col("low").alias("lo"), F.col("high").alias("hi"), "left", "right", "alone"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _span_lists(contexts: DataFrame, grams: DataFrame, length: int, gram: int, together: int) -> DataFrame:
    """(k1, k2, spans) over all grams, one row of ``grams`` for each context; groups of frequent grams are split."""
    frequent = written(grams.groupBy("h").count().filter(F.col("count") > together).select("h"), "suffix-frequent")
    place, hi = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(F.lit(255)).cast("int")
    lo = hi - F.col("spot").bitwiseAND(F.lit(255)).cast("int")
    shaped = contexts.select("h", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"), "k1", "k2", place.alias("place"), lo.alias("lo"), hi.alias("hi"), "left", "right", F.lit(True).alias("alone"))
    if not frequent.limit(1).count():
        return _listed([_sorted_spans(shaped, length, gram)])
    spans = [_sorted_spans(shaped.join(frequent, "h", "left_anti"), length, gram)]
    rows, width = shaped.join(frequent, "h", "left_semi").drop("h"), 256
    while True:
        full, different = _folded(rows, length)
        sizes = written(different.groupBy("key").count().filter("count > 1"), "suffix-sizes")
        spans += [full, _sorted_spans(different.join(sizes.filter(F.col("count") <= together), "key"), length, gram)]
        large = sizes.filter(F.col("count") > together).select("key")
        if width == 1 or not large.limit(1).count():
            return _listed(spans)
        width //= 4
        rows = _quarters(different.join(large, "key"), width, length, gram)


def _listed(spans: list[DataFrame]) -> DataFrame:
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """One row for each row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.sha2(body, 256)
    key = lambda start: F.conv(F.substring("sha", start, 15), 16, 10).cast("bigint")
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), body.alias("body"), digest.alias("sha")).select("doc_id", "body", key(1).alias("k1"), key(16).alias("k2"))
    found = rows.select("k1", "k2", "body").filter(F.octet_length("body") >= length).mapInArrow(_anchor_rows(length, gram), "h bigint, k1 bigint, k2 bigint, spot bigint")
    place = F.xxhash64("k1", "k2", F.shiftright("spot", 16))
    grams = found.select("h", place.alias("p")).groupBy("h").agg(F.min("p").alias("x"), F.max("p").alias("y")).filter("x != y").select("h")
    grams = written(grams, "suffix-grams")
    flagged = found.join(grams, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "spot")).alias("spots"))
    # One row for each different text; partial aggregation folds copies before the shuffle.
    texts = rows.groupBy("k1", "k2").agg(F.first("body").alias("body"), F.count("*").alias("n")).join(flagged, ["k1", "k2"], "left")
    whole = (F.col("n") > 1) & (F.octet_length("body") >= length)
    n_bytes = F.octet_length("body").cast("bigint")
    texts = texts.select(
        "k1",
        "k2",
        whole.alias("whole"),
        n_bytes.alias("n_bytes"),
        F.when(F.col("spots").isNull(), F.sha2("body", 256)).alias("sha"),
        F.when(F.col("spots").isNotNull(), F.col("body")).alias("body"),
        "spots",
    )
    texts = written(texts, "suffix-texts")
    release(grams)
    some = texts.filter(F.col("spots").isNotNull())
    contexts = some.select("k1", "k2", "body", "spots").mapInArrow(_context_rows(length), _CONTEXT)
    places = some.select(F.explode("spots.h").alias("h"))
    lists = written(_span_lists(contexts, places, length, gram, together), "suffix-spans")
    cut = some.filter("not whole").select("k1", "k2", "body").join(lists, ["k1", "k2"], "left").select("k1", "k2", "body", "spans").mapInArrow(_cut_rows(), "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    zero, empty = F.lit(0).cast("bigint"), F.lit(hashlib.sha256(b"").hexdigest())
    plain = texts.filter(F.col("spots").isNull() | F.col("whole")).select(
        "k1",
        "k2",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(zero).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1).cast("bigint")).otherwise(zero).alias("n_spans"),
        F.when(F.col("whole"), empty).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    results = written(plain.unionByName(cut), "suffix-results")
    release(texts)
    release(lists)
    mine = rows.select("doc_id", F.octet_length("body").cast("bigint").alias("n_bytes"), "k1", "k2")
    return mine.join(results, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
