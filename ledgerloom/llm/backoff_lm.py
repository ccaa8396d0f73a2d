"""Language-model scores by a weighted backoff automaton.

The model is of n-grams with Dirichlet smoothing: a word w after a history h has the probability
``(c(h w) + K * p(w | h')) / (c(h) + K)``, where h' is h without its first word and c counts training texts; single words
have ``(c(w) + 1) / (N + V + 1)``. Every history that was counted is a state. An n-gram that was counted is an arc with its log
probability; for anything else a state has a failure arc to the state of h' with the weight ``K / (c(h) + K)``. One
traversal of a text from left to right carries the state and adds up what it passes.

Tokens: words (anything but space and tab to carriage return) with A to Z lowered, then one end. The end is also the history of a
text's first word, so that probabilities after any history sum to one.

Scale: the automaton grows with the corpus, so no machine holds it. Texts are encoded once, into blocks of a bounded
number of tokens. A block sends the keys of its distinct n-grams (64 bits for words, 56 for longer ones), with their counts in its training texts, to
ranges of keys, as many as the corpus needs; a range adds up equal keys, of which a block has one each, and sends the totals back in
the order in which they came. With these each block builds its own part of the automaton, which is all that its texts
can reach. Two n-grams that share a key would share a count: at a billion distinct words the odds of one such pair are 1 in 37, at a billion
longer n-grams some seven pairs do.

Edge cases: a null text is an empty one and has one token, its end. Each row is a document of its own, whatever ids repeat; a null
id is the text ``null``. A corpus without training texts gives every token the probability 1. Whole texts are
scored, however long. An empty table gives an empty table; other columns are ignored unless kept, and a kept column that has the
name of a result gives way to it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.scratch import written

#: Tokens of a block; a longer text is a block of its own.
BLOCK = 1 << 19
#: Tokens of the corpus for each range of keys.
RANGE = 1 << 21
ORDER = 2
#: Weight of the shorter history, in tokens.
PRIOR = 100.0
#: No word is empty.
END = b""

FIELDS = T.StructType(
    [T.StructField("held_out", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    + [T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    """The seventh of all documents that nothing is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    # Bytes split at exactly the space and tab to carriage return.
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


# Blocks.


def encoded_blocks(df: DataFrame, text: str, test: Column, keep: Sequence[str]) -> DataFrame:
    """Each document's tokens as places in its block's vocabulary, and a block's vocabulary as keys in the row of its first document."""
    fields = [T.StructField("__block", T.LongType()), T.StructField("__n", T.LongType()), T.StructField("__tokens", T.BinaryType()), T.StructField("__keys", T.BinaryType())]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(test, F.lit(False)).alias("__test"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, rows, size, places = [], [], 0, {END: 0}

        def flush() -> Iterator[pa.RecordBatch]:
            # Rows of a block lie in one or more batches; its vocabulary goes with the first.
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in places), np.uint64, len(places)).tobytes()
            first = True
            for part, tokens in zip(held, rows):
                if not tokens:
                    continue
                made = [[block] * len(tokens), list(map(len, tokens)), list(map(packed, tokens)), [keys if first and not i else None for i in range(len(tokens))]]
                first = False
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, f.type) for v, f in zip(made, arrow))], names=schema.names)

        for batch in batches:
            texts, start = batch.column(batch.num_columns - 1), 0
            kept = batch.select(range(batch.num_columns - 1))
            current: list[np.ndarray] = []
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                if size and size + len(words) >= BLOCK:
                    held.append(kept.slice(start, i - start))
                    rows.append(current)
                    yield from flush()
                    block, held, rows, current, size, places, start = block + 1, [], [], [], 0, {END: 0}, i
                n = len(places)
                for w in words:
                    if w not in places:
                        places[w] = n
                        n += 1
                current.append(np.array([*map(places.__getitem__, words), 0], np.int32))
                size += len(words) + 1
            held.append(kept.slice(start))
            rows.append(current)
        if size:
            yield from flush()

    return source.mapInArrow(run, schema)


def packed(values: np.ndarray) -> bytes:
    """Integers compressed byte by byte, all lowest bytes first: small ones leave long runs of zeros."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    bytes_ = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(bytes_.reshape(size, len(bytes_) // size).T).view(kind).ravel()


class Grams:
    """The distinct n-grams of a block, by order: their codes, keys, and counts in its training documents.

    The code of a longer n-gram is that of its history's place among the codes one order below, and its last word. All of it
    follows from the documents alone, so the block that gets totals back finds them in the order in which they were sent.
    """

    def __init__(self, documents: pa.Table, order: int):
        # A shuffle doesn't keep the order of rows; codes and counts don't depend on it.
        self.lengths = documents.column("__n").to_numpy()
        self.tokens = np.concatenate([unpacked(x, np.int32) for x in documents.column("__tokens").to_pylist()])
        (self.words,) = (np.frombuffer(k, np.int64) for k in documents.column("__keys").to_pylist() if k is not None)
        train = np.repeat(~documents.column("__test").to_numpy(), self.lengths)
        ends = np.cumsum(self.lengths)
        first = np.zeros(len(self.tokens), bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        # The history of a first word is an end.
        before = np.where(first, 0, np.roll(self.tokens, 1)).astype(np.int64)
        self.codes, self.keys, self.counts = [np.arange(len(self.words))], [self.words], [np.bincount(self.tokens[train], minlength=len(self.words))]
        # ``ended``: the place of the n-gram that ends at each position, -1 if it would begin before its text.
        ended, ready = self.tokens.astype(np.int64), np.ones(len(self.tokens), bool)
        for n in range(1, order):
            history = np.where(first, -1, np.roll(ended, 1)) if n > 1 else before
            ready = history >= 0
            codes, places = np.unique(history[ready] * len(self.words) + self.tokens[ready], return_inverse=True)
            counts = np.bincount(places[train[ready]], minlength=len(codes))
            keys = _mixed(self.keys[-1][codes // len(self.words)], self.words[codes % len(self.words)])
            self.codes.append(codes)
            self.keys.append(keys)
            self.counts.append(counts)
            ended = np.full(len(self.tokens), -1, np.int64)
            ended[ready] = places


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A key of 56 bits for a history's key and a word's."""
    x = history.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    # The lowest byte is the dearest to send.
    return (x & ~np.uint64(255)).view(np.int64)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(40)).astype(np.int64) * ranges) >> 24


def _by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): keys in unsigned order, and where each range ends."""
    order = np.argsort(keys.view(np.uint64), kind="stable")
    return order, np.searchsorted(_range_of(keys[order], ranges), np.arange(ranges), side="right")


_SENT = "of_range int, n int, of_block long, keys binary, counts binary"
_TOTAL = "of_range int, n int, of_block long, totals binary, distinct long, counted long"


def totals(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """(of_range, n, of_block, totals, distinct, counted): for each block, order and range the training counts of the block's n-grams.

    ``distinct`` and ``counted``: single words of the range that training has, and how often; in one row of each range.
    """

    def send(documents: pa.Table) -> pa.Table:
        grams, block = Grams(documents, order), documents.column("__block")[0].as_py()
        out: dict[str, list] = {c: [] for c in ("of_range", "n", "of_block", "keys", "counts")}
        for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts)):
            at, ends = _by_range(keys, ranges)
            for r, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                if end > start:
                    steps = np.diff(keys[at[start:end]].view(np.uint64) >> np.uint64(8 * (n > 0)), prepend=np.uint64(0))
                    for c, v in zip(out, (r, n, block, packed(steps), packed(counts[at[start:end]].astype(np.int32)))):
                        out[c].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=[*out])

    def add(sent: pa.Table) -> pa.Table:
        rows = sent.num_rows
        keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in sent.column("keys").to_pylist()]
        _, places = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(places, np.concatenate([unpacked(x, np.int32) for x in sent.column("counts").to_pylist()]))
        found = list(map(packed, np.split(sums[places].astype(np.int64), np.cumsum(list(map(len, keys)))[:-1])))
        single = sent.column("n")[0].as_py() == 0
        distinct, counted = (int((sums > 0).sum()), int(sums.sum())) if single else (0, 0)
        columns = [sent.column("of_range"), sent.column("n"), sent.column("of_block"), pa.array(found, pa.binary()), pa.array([distinct, *[0] * (rows - 1)]), pa.array([counted, *[0] * (rows - 1)])]
        return pa.table(columns, names=["of_range", "n", "of_block", "totals", "distinct", "counted"])

    needed = blocks.select("__block", "__n", "__test", "__tokens", "__keys")
    return needed.groupBy("__block").applyInArrow(send, _SENT).groupBy("of_range", "n").applyInArrow(add, _TOTAL)


# The automaton.


class BackoffAutomaton:
    """States, arcs and failure arcs of the part of the model that a block's texts can reach.

    A state is a history, by its place among the n-grams of its order; the empty history is the root, which has an arc for each
    word. An arc leads to the longest history that training has.
    """

    def __init__(self, grams: Grams, counts: Sequence[np.ndarray], tokens: int, distinct: int, prior: float):
        words = len(grams.words)
        self.width = words
        p = (counts[0] + 1.0) / (tokens + distinct + 1.0)
        self.base = np.log10(p)
        # State 0 is the root; the n-gram of order n at place i is state starts[n] + i, if it is ever a history.
        starts = np.cumsum([1, *map(len, grams.codes)])
        arcs, gains, targets = {}, array("d"), array("q")

        def add(keys: np.ndarray, p: np.ndarray, state: np.ndarray) -> None:
            arcs.update(zip(keys.tolist(), range(len(gains), len(gains) + len(keys))))
            gains.frombytes(p.astype(np.float64).tobytes())
            targets.frombytes(state.astype(np.int64).tobytes())

        weights, fails = [0.0], [0]
        state = np.where(counts[0] > 0, starts[0] + np.arange(words), 0) if len(grams.codes) > 1 else np.zeros(words, np.int64)
        add(np.arange(words), self.base, state)
        suffix_p, suffix_state = p, state
        for n in range(1, len(grams.codes)):
            # Histories of order n: what they weigh when a word isn't theirs, and where they go then.
            weights += np.log10(prior / (counts[n - 1] + prior)).tolist()
            fails += (np.zeros(words, np.int64) if n == 1 else suffix_of_history).tolist()
            history, word = grams.codes[n] // words, grams.codes[n] % words
            shorter = word if n == 1 else self._shorter(grams, n, history, word)
            p = (counts[n] + prior * suffix_p[shorter]) / (counts[n - 1][history] + prior)
            known = counts[n] > 0
            own = starts[n] + np.arange(len(known)) if n + 1 < len(grams.codes) else np.zeros(len(known), np.int64)
            state = np.where(known & (own > 0), own, suffix_state[shorter])
            keys = (starts[n - 1] + history[known]) * words + word[known]
            add(keys, np.log10(p[known]), state[known])
            suffix_of_history = suffix_state[shorter]
            suffix_p, suffix_state = p, state
        self.arcs, self.gains, self.targets, self.weights, self.fails = arcs, gains, targets, weights, fails
        self.start = int(starts[0]) if len(grams.codes) > 1 and counts[0][0] > 0 else 0

    @staticmethod
    def _shorter(grams: Grams, n: int, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place, one order below, of each n-gram without its first word."""
        words = len(grams.words)
        inner = grams.codes[n - 1][history] % words if n == 2 else BackoffAutomaton._shorter(grams, n - 1, grams.codes[n - 1][history] // words, grams.codes[n - 1][history] % words)
        return np.searchsorted(grams.codes[n - 1], inner * words + word)

    def score(self, tokens: Sequence[int]) -> float:
        arcs, gains, targets, weights, fails, width = self.arcs, self.gains, self.targets, self.weights, self.fails, self.width
        state, total = self.start, 0.0
        for w in tokens:
            while (arc := arcs.get(state * width + w)) is None:
                total += weights[state]
                state = fails[state]
            total += gains[arc]
            state = targets[arc]
        return total


def score_texts(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ("doc_id",), order: int = ORDER, prior: float = PRIOR, test: Column | None = None) -> DataFrame:
    """Base and model scores of each row's text; rows where ``test`` holds are scored but not learnt from."""
    keep = [c for c in dict.fromkeys(keep) if c not in FIELDS.names and not c.startswith("__")]
    blocks = written(encoded_blocks(df, text, held_out(F.col(f"`{doc_id}`")) if test is None else test, keep), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    ranges = max(1, -(-tokens // RANGE))
    counted = written(totals(blocks, order, ranges), "lm-totals")
    distinct, train = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("counted"), F.lit(0))).first()
    schema = T.StructType([*(blocks.schema[c] for c in keep), *FIELDS.fields])

    def fill(documents: pa.Table, found: pa.Table) -> pa.Table:
        grams = Grams(documents, order)
        counts = []
        by_place = sorted(zip(found.column("n").to_pylist(), found.column("of_range").to_pylist(), range(found.num_rows)))
        lists = found.column("totals")
        for n, keys in enumerate(grams.keys):
            at, _ = _by_range(keys, ranges)
            sorted_ = np.concatenate([unpacked(lists[i].as_py(), np.int64) for m, _, i in by_place if m == n])
            back = np.empty(len(keys), np.int64)
            back[at] = sorted_
            counts.append(back)
        automaton = BackoffAutomaton(grams, counts, train, distinct, prior)
        known = counts[0] > 0
        made: dict[str, list] = {name: [] for name in FIELDS.names}
        end = 0
        for test, n in zip(documents.column("__test").to_pylist(), grams.lengths.tolist()):
            start, end = end, end + n
            tokens_ = grams.tokens[start:end]
            for name, value in zip(FIELDS.names, (test, n, int(known[tokens_].sum()), train, float(automaton.base[tokens_].sum()), automaton.score(tokens_.tolist()))):
                made[name].append(value)
        arrow = to_arrow_schema(FIELDS)
        return pa.table([*documents.select(keep).columns, *(pa.array(made[f.name], f.type) for f in arrow)], names=schema.names)

    return blocks.groupBy("__block").cogroup(counted.groupBy("of_block")).applyInArrow(fill, schema)
