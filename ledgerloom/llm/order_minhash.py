"""Near-duplicate detection by Order MinHash.

A text's five-word shingles are labelled with their occurrence number, so repeats count. Each of many hash orders picks
the two least labelled shingles, and the pair is kept in the order in which the two stand in the text: sketches agree
only where texts share shingles in the same order, which follows edit similarity. Sketches are combined into bands; texts
that share a band are candidates, and a banded alignment of their words verifies them: a link needs an edit distance of
at most a fifth of the longer text's words (similarity 0.8). Classes are the components of the links.

With 40 bands of two sketches of two shingles, each band catches a pair of shingle similarity s with probability about
s ** 4: at 0.8 a pair escapes with probability under 1e-9, at 0.6 under 0.5 %. Equal texts are one node from the start.

A bucket of thousands of texts is not compared pair by pair. Its members first meet two of its members, and where the bucket
then still holds several components, members outside the largest one meet that one's best linked member and one picked by hash.
The texts of all buckets that still hold several components go through an exact join, so no link between texts that share a
band is lost: texts within the edit distance share all but a fifth of the longer one's words, counted with repeats, so they share one of
each text's rarest fifth of words and one more. Words that only one component has count as rarest and join nothing. Pairs that meet so,
in different components, are aligned unless their words, or bits set by them, show too many differences; first each text with its
likeliest partner, then what is still apart. The join's rows are pairs of texts that share a rare word; among very many texts that are
all about a fifth apart, those are quadratic by nature, in rows of a few hundred bytes that Spark deals out and spills.

Edge cases: a text of fewer than five words is one shingle of all its words; very long texts are sketched and aligned whole, in a band
as wide as a fifth of their words. Null texts and null ids are classes of their own. Empty texts equal each other. Rows
that share an id but not their text are documents of their own, told apart by text. An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.llm.alignment import similar
from ledgerloom.llm.common import map_texts
from ledgerloom.llm.components import components
from ledgerloom.scratch import release, written

SHINGLE = 5
BANDS = 40
SKETCHES_PER_BAND = 2
PERCENT = 80
#: Longs of a text's bits, of which each word sets one.
BIT_LONGS = 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_SKETCH = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_BAG = T.StructType([T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("n_bits", T.LongType())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's occurrence-labelled shingles in text order, from its words' hashes."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, SHINGLE)
    plain = sum((words[i : n - k + 1 + i] * _POWERS[i] for i in range(1, k)), words[: n - k + 1] * _POWERS[0])
    return labelled(_mixed(plain + np.uint64(k)))


def labelled(plain: np.ndarray) -> np.ndarray:
    """The hashes mixed with their occurrence number among equal ones."""
    order = np.argsort(plain, kind="stable")
    ranked = plain[order]
    at = np.arange(len(ranked))
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    occurrence = np.empty(len(ranked), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return _mixed(plain + occurrence * _M2)


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text's words as occurrence-labelled hashes, and as bits."""
    import xxhash

    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    tokens = labelled(hashed) if len(words) else hashed
    bits = np.zeros(BIT_LONGS * 64, np.uint8)
    bits[tokens % np.uint64(len(bits))] = 1
    return tokens.view(np.int64), np.packbits(bits).view(np.int64)


class Sketcher:
    """Band keys of texts; the hash orders follow from the seed."""

    def __init__(self, bands: int = BANDS, per_band: int = SKETCHES_PER_BAND, seed: int = 5):
        import xxhash

        rng = np.random.default_rng(seed)
        self.count = bands * per_band
        self.per_band = per_band
        self.factors = rng.integers(0, 1 << 63, self.count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.labels = rng.integers(0, 1 << 63, self.count, np.uint64)
        self.word_hash = xxhash.xxh3_64_intdigest

    def sketches(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        first, second = np.empty(self.count, np.int64), np.empty(self.count, np.int64)
        step = max(1, 2_000_000 // n)
        for a in range(0, self.count, step):
            ranks = shingles * self.factors[a : a + step, None]
            rows = np.arange(len(ranks))
            first[a : a + step] = least = ranks.argmin(axis=1)
            if n > 1:
                ranks[rows, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
            second[a : a + step] = ranks.argmin(axis=1)
        early, late = np.minimum(first, second), np.maximum(first, second)
        return _mixed(shingles[early] * _M1 + _mixed(shingles[late] + self.labels))

    def bands(self, words: list[bytes]) -> np.ndarray | None:
        if not words:
            return None
        hashed = np.fromiter(map(self.word_hash, words), np.uint64, len(words))
        made = self.sketches(shingle_hashes(hashed)).reshape(-1, self.per_band)
        keys = made[:, 0]
        for i in range(1, self.per_band):
            keys = _mixed(keys * _M2 + made[:, i])
        return keys.view(np.int64)


def _text_key(text: Column) -> Column:
    """Sixteen bytes of a cryptographic digest stand for the text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _may_align(a: list[str], b: list[str], percent: int) -> bool:
    """Whether the texts share so many words, counted with repeats, as an alignment needs."""
    longest = max(len(a), len(b))
    return (longest - (Counter(a) & Counter(b)).total()) * 100 <= longest * (100 - percent)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, likely: bool = True) -> DataFrame:
    """The pairs (u, v) of nodes whose texts align; where few are ``likely`` to, their words are counted first."""
    a = texts.select(F.col("node").alias("u"), F.col("body").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("body").alias("b"))
    joined = pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                split = ((x.split(), y.split()) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
                good = [(likely or _may_align(x, y, percent)) and similar(x, y, percent) for x, y in split]
                yield pa.RecordBatch.from_arrays([*part.select(["u", "v"]).columns], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(check, "u bigint, v bigint")


def _close_lengths(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _moved(homes: DataFrame, links: DataFrame) -> DataFrame:
    """``homes`` after more links have joined components."""
    home = homes.select("node", "home")
    between = links.join(home.toDF("u", "a"), "u").join(home.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    moved = components(between).toDF("home", "to")
    return written(homes.join(moved, "home", "left").select("node", "n_words", F.coalesce("to", "home").alias("home"), "degree"), "omh-homes")


def _unsettled(members: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (band, node, n_words, home, degree), and the buckets (band, main) that hold several components; main is the largest."""
    here = written(members.select("band", "node").join(homes, "node"), "omh-level")
    best, any_ = F.max(F.struct("degree", "node", "n_words")), F.min(F.struct(F.xxhash64("node", "band").alias("rank"), "node", "n_words"))
    by_home = here.groupBy("band", "home").agg(F.count("*").alias("n"), best.alias("best"), any_.alias("any"))
    member = lambda c: F.struct(F.col(f"{c}.node").alias("node"), F.col(f"{c}.n_words").alias("n_words")).alias(c)
    buckets = by_home.groupBy("band").agg(F.min("home").alias("x"), F.max("home").alias("y"), F.max(F.struct("n", "home", member("best"), member("any"))).alias("main"))
    return here, written(buckets.filter("x != y").drop("x", "y"), "omh-buckets")


def rare_words(docs: DataFrame, percent: int) -> DataFrame:
    """(node, prefix, ranks): of docs (node, home, n, tokens), the tokens of which two texts of different homes share one if they are similar.

    Tokens are taken in one order for all texts, those of a single home first, then the rarest; those of a single home are left out
    afterwards. ``ranks`` are the places, from 1, of the tokens in that order.
    """
    every = Window.partitionBy("token")
    own = Window.partitionBy("node").orderBy(F.desc("lone"), "held", "token")
    tokens = docs.select("node", "home", "n", F.explode("tokens").alias("token"))
    seen = tokens.withColumns({"held": F.count("*").over(every), "lone": F.min("home").over(every) == F.max("home").over(every)})
    first = seen.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= F.expr(f"n * {100 - percent} div 100 + 1")).filter(~F.col("lone"))
    sorted_ = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("sorted"))
    return sorted_.select("node", F.col("sorted.token").alias("prefix"), F.col("sorted.rank").alias("ranks"))


def meetings(heads: DataFrame, percent: int) -> DataFrame:
    """(u, v, apart): the pairs of heads (node, home, n, bits, n_bits, prefix, ranks) of different homes that may be similar, each once.

    A pair meets at the first token that both prefixes hold: what is shared comes at that token or later, and the bits that one text
    has beyond the other, ``apart``, are words that it has beyond the other.
    """
    rows = heads.select("*", F.posexplode("prefix").alias("at", "token")).withColumn("rank", F.col("ranks")[F.col("at")]).drop("ranks", "at")
    longest = F.greatest("a.n", "b.n")
    most = F.floor(longest * (100 - percent) / 100)
    both = F.aggregate(F.zip_with("a.bits", "b.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    apart = F.greatest("a.n_bits", "b.n_bits") - both
    met = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.home") != F.col("b.home"))
    met &= F.least(F.col("a.n") - F.col("a.rank"), F.col("b.n") - F.col("b.rank")) + 1 >= longest - most
    met &= apart <= most
    met &= F.array_intersect("a.prefix", "b.prefix")[0] == F.col("a.token")
    return rows.alias("a").join(rows.alias("b"), met).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), apart.alias("apart"))


def _possible(texts: DataFrame, homes: DataFrame, here: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """(u, v, apart): all pairs of texts of unsettled buckets that are in different components and may be similar."""

    def make():
        def work(bodies):
            made = [bag((x or "").split()) for x in bodies]
            return {"n": [len(t) for t, _ in made], "tokens": [t for t, _ in made], "bits": [b for _, b in made], "n_bits": [int(np.bitwise_count(b.view(np.uint64)).sum()) for _, b in made]}

        return work

    left = here.join(buckets.select("band"), "band", "left_semi").select("node").distinct()
    docs = written(map_texts(texts.join(left, "node").join(homes.select("node", "home"), "node"), "body", make, _BAG, ["node", "home"]), "omh-bags")
    heads = written(docs.drop("tokens").join(rare_words(docs, percent), "node"), "omh-heads")
    release(docs)
    pairs = written(meetings(heads, percent).distinct(), "omh-possible")
    release(heads)
    return pairs


def _refined(members: DataFrame, texts: DataFrame, links: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """(node, home): the components that the links and all others between members of a bucket make; ``links`` and ``tested`` hold pairs (u, v)."""
    degrees = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    label = components(links)
    homes = members.select("node", "n_words").distinct().join(label, "node", "left").join(degrees, "node", "left")
    homes = written(homes.select("node", "n_words", F.coalesce("component", "node").alias("home"), F.coalesce("degree", F.lit(0)).alias("degree")), "omh-homes")

    def joined(homes: DataFrame, pairs: DataFrame, likely: bool = True) -> DataFrame:
        found = written(_verified(pairs, texts, percent, likely).distinct(), "omh-found")
        moved = _moved(homes, found) if found.limit(1).count() else homes
        for used in (found, *([homes] if moved is not homes else [])):
            release(used)
        return moved

    here, buckets = _unsettled(members, homes)
    outside = here.join(buckets, "band").filter(F.col("home") != F.col("main.home"))
    stars = outside.select("node", "n_words", F.explode(F.array("main.best", "main.any")).alias("c")).filter(_close_lengths(F.col("n_words"), F.col("c.n_words"), percent))
    stars = written(stars.select(*_pair(F.col("node"), F.col("c.node"))).distinct().join(tested, ["u", "v"], "left_anti"), "omh-pairs")
    homes = joined(homes, stars)
    tested = tested.unionByName(stars)
    for used in (here, buckets):
        release(used)

    here, buckets = _unsettled(members, homes)
    pairs = written(_possible(texts, homes, here, buckets, percent).join(tested, ["u", "v"], "left_anti"), "omh-rest")
    likeliest = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.struct("apart", "u", "v").alias("pair")).groupBy("node").agg(F.min("pair").alias("pair"))
    likeliest = written(likeliest.select("pair.u", "pair.v").distinct(), "omh-likeliest")
    homes = joined(homes, likeliest, False)
    home = homes.select("node", "home")
    rest = pairs.join(home.toDF("u", "a"), "u").join(home.toDF("v", "b"), "v").filter("a != b").select("u", "v")
    rest = written(rest.join(likeliest, ["u", "v"], "left_anti"), "omh-last")
    homes = joined(homes, rest, False)
    for used in (here, buckets, stars, pairs, likeliest, rest):
        release(used)
    return homes.select("node", "home")


def _classes(rows: DataFrame, bands: int, percent: int) -> DataFrame:
    """(key, n_copies, class_id, class_key) for each different text of rows (doc_id, body, key); the class's least id, and the text that has it."""
    real = rows.filter(F.col("doc_id").isNotNull() & F.col("key").isNotNull())

    def make():
        sketcher = Sketcher(bands)

        def work(texts):
            split = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
            return {"n_words": list(map(len, split)), "bands": [sketcher.bands(w) for w in split]}

        return work

    sketched = map_texts(real, "body", make, _SKETCH, ["doc_id", "key"])
    # Partial aggregation folds equal texts before the shuffle, however many there are. Written numbers stay as they are.
    nodes = sketched.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "omh-nodes")
    keyed = nodes.select("node", "n_words", F.posexplode("bands").alias("place", "band"))
    # Two members of each bucket are its centers: the least, and the least by a hash.
    least = F.min(F.struct("node", "n_words")), F.min(F.struct(F.xxhash64("node").alias("rank"), "node", "n_words"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n"), least[0].alias("x"), least[1].alias("y")).filter("n > 1")
    centers = F.array(*(F.struct(F.col(f"{c}.node").alias("node"), F.col(f"{c}.n_words").alias("n_words")) for c in "xy"))
    members = written(keyed.join(shared.select("band", centers.alias("centers")), "band"), "omh-members")
    stars = members.select("node", "n_words", F.explode("centers").alias("c")).filter("node != c.node").filter(_close_lengths(F.col("n_words"), F.col("c.n_words"), percent))
    stars = written(stars.select(*_pair(F.col("node"), F.col("c.node"))).distinct(), "omh-stars")
    wanted = nodes.select("node", "key", "first_id").join(members.select("node").distinct(), "node", "left_semi")
    texts = real.select("key", F.col("doc_id").alias("first_id"), "body").join(wanted, ["key", "first_id"]).select("node", "body")
    texts = written(texts, "omh-texts")
    if texts.count() > members.select("node").distinct().count():  # rows repeated with id and text
        once = written(texts.groupBy("node").agg(F.first("body").alias("body")), "omh-texts")
        release(texts)
        texts = once
    links = written(_verified(stars, texts, percent).distinct(), "omh-links")
    homes = written(_refined(members, texts, links, stars, percent), "omh-classes")
    for used in (members, stars, texts, links):
        release(used)
    named = nodes.select("key", "first_id", "n_copies", "node").join(homes, "node", "left").withColumn("home", F.coalesce("home", "node"))
    least_of = named.groupBy("home").agg(F.min(F.struct("first_id", "key")).alias("least"))
    return named.join(least_of, "home").select("key", "n_copies", F.col("least.first_id").alias("class_id"), F.col("least.key").alias("class_key"))


def _rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), body.alias("body"), _text_key(body).alias("key"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row: (doc_id, class_id, is_kept, n_copies); ``class_id`` is the class's least id.

    ``is_kept`` marks the class's document of least id (of that id's texts, the one of least digest); ``n_copies`` counts
    rows with an equal text.
    """
    rows = _rows(df, id_column, text)
    found = rows.select("doc_id", "key").join(_classes(rows, bands, percent), "key", "left")
    class_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "doc_id"))
    kept = (F.col("doc_id") == class_id) & (F.col("class_key").isNull() | (F.col("class_key") == F.col("key")))
    return found.select("doc_id", class_id.alias("class_id"), F.coalesce(kept, F.lit(True)).alias("is_kept"), F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.coalesce("n_copies", F.lit(1))).cast("bigint").alias("n_copies"))


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, that are the kept document of their class; rows repeated with id and text count once.

    Rows without an id or a text all stay.
    """
    rows = _rows(df, id_column, text)
    classes = _classes(rows, bands, percent)
    seen = rows.filter(F.col("doc_id").isNotNull() & F.col("key").isNotNull()).groupBy("key", "doc_id").agg(F.count("*").alias("times"))
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))
    seen = written(seen.join(classes, "key").select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), "times", kept.alias("kept")), "omh-verdicts")
    keyed = df.withColumns({"__own_key": _text_key(F.col(f"`{text}`").cast("string")), "__own_id": F.col(f"`{id_column}`").cast("bigint")})
    same = (F.col("__own_key") == F.col("__key")) & (F.col("__own_id") == F.col("__id"))
    out = keyed.join(seen.filter("not kept").select("__key", "__id"), same, "left_anti")
    repeated = seen.filter("kept and times > 1").select("__key", "__id")
    if not repeated.limit(1).count():
        return out.select(df.columns)
    once = out.join(repeated, same, "left_semi").dropDuplicates(["__own_key", "__own_id"])
    return out.join(repeated, same, "left_anti").unionByName(once).select(df.columns)
