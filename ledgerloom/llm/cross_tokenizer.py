"""Alignment of two tokenizers by byte-owner arrays.

Both tokenizers read the same bytes: a space and the text. Repeating each token's index over its bytes gives an array of
owners for each of them. Where either owner changes, a new pair of overlapping tokens begins; where both change at once,
both tokenizers have a token end, and the text is cut into groups. Pairs of ids are counted by the documents that hold
them, and each document is told how common its own pairs are.

Scale: texts are encoded once, into a table of blocks. A block is a run of documents of one task with a bounded number of
overlaps, or one document that has more. Its distinct pairs, not its documents', meet the corpus-wide counts, so the common
pairs of a block travel once; counts return to the block's documents in a cogroup of one block at a time. The best count of
an id is a maximum over at most the other vocabulary's ids.

Edge cases: a null or empty text, and one whose bytes a tokenizer doesn't give back (U+2581 reads as a space), has no tokens:
zeros and an empty digest. Special tokens' strings inside a text are plain text. Whole texts are encoded, however long. Each
row is a document of its own, whatever ids repeat. An empty table gives an empty table, other columns are ignored
unless kept, and a kept column that has the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.common import tiktoken_ranks, vocabulary_path
from ledgerloom.scratch import written

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Overlaps of a block; a longer document is a block of its own.
BLOCK = 1 << 19
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 20
#: Segments of texts whose pieces a worker keeps.
KNOWN = 400_000
#: Room for an id of B in the code of a pair.
B_BITS = 20

FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())])
FULL = T.StructType([*FIELDS.fields, T.StructField("groups", T.StringType())])
_CODES = T.StructType([T.StructField("__block", T.LongType()), T.StructField("__pairs", T.ArrayType(T.LongType())), T.StructField("__times", T.ArrayType(T.IntegerType()))])
#: Up to a space behind anything but white space. Neither tokenizer joins bytes across such a place: no piece of B has a space behind
#: another character, and no word of A has white space behind anything else. So segments are encoded by themselves.
_SEGMENT = re.compile("(?s).(?:[^ ]+|(?<=[\\s\x1c-\x1f\x85]) )*")


class Side:
    """One tokenizer's view of a text: the bytes of each id, and how an id is shown in a list of groups."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        #: By the mark that follows (none, comma, bar, semicolon), then by id.
        self.shown = np.array([f"{i}{mark}" for mark in ("", ",", "|", ";") for i in range(len(tokens))], "S")

    def owners(self, ids: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(ids)), self.lengths[ids])


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        ranks = tiktoken_ranks(a_path)
        import public_tokenizers

        self.a_encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        found = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            found[rank] = token
        self.a = Side(found)
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b_model.id_to_piece(i) for i in range(self.b_model.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with inner spaces")
        self.space = self.b_model.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, parts: set[str]) -> None:
        """Encodes segments that aren't known, as 32-bit ids; one that isn't spelled by its pieces of B gets an id of -1."""
        if len(self.known) + len(parts) > KNOWN:
            self.known.clear()
        new = list(parts - self.known.keys())
        if not new:
            return
        # One text of all segments is cut again where they meet; those that end in white space go by themselves.
        ended = [p for p in new if not p[-1].isspace()]
        ids = np.array(self.a_encoding.encode_ordinary("".join(ended)), np.int32)
        ends = np.cumsum([len(p.encode()) for p in ended])
        upto = np.searchsorted(np.cumsum(self.a.lengths[ids]), ends) + 1
        a_made = dict(zip(ended, np.split(ids, upto[:-1])))
        # The model puts one space before what it encodes.
        b_made = self.b_model.encode([p[1:] for p in new], num_threads=1)
        for part, b in zip(new, b_made):
            a = a_made[part].tobytes() if part in a_made else array("i", self.a_encoding.encode_ordinary(part)).tobytes()
            b = [-1] if "▁" in part else b if len(part) > 1 else [self.space]
            self.known[part] = a, array("i", b).tobytes()

    def encode(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each text; None where they don't spell a space and the text."""
        parts = [_SEGMENT.findall(" " + x) if x else [] for x in texts]
        self._learn(set().union(*parts))
        known = self.known
        for found in parts:
            if not found:
                yield None
                continue
            a_ids, b_ids = (np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in zip(*map(known.__getitem__, found)))
            same = b_ids.min() >= 0 and self.a.lengths[a_ids].sum() == self.b.lengths[b_ids].sum()
            yield (a_ids, b_ids) if same else None


def overlaps(a_owner: np.ndarray, b_owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B, whether a cut stands before) for each pair of overlapping tokens, in order."""
    a_new, b_new = np.diff(a_owner) != 0, np.diff(b_owner) != 0
    at = np.concatenate([[0], np.flatnonzero(a_new | b_new) + 1])
    cut = np.concatenate([[True], (a_new & b_new)[at[1:] - 1]])
    return a_owner[at], b_owner[at], cut


def group_text(a: Side, b: Side, a_ids: np.ndarray, b_ids: np.ndarray, a_token: np.ndarray, b_token: np.ndarray, cut: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids of A, then of B, of each group."""
    group = np.cumsum(cut) - 1
    side_of = np.concatenate([np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)])
    place = np.empty(len(side_of), np.int64)
    place[a_token], place[b_token + len(a_ids)] = 2 * group, 2 * group + 1
    # The sides of a group take turns; a token is its side's last if the next one's place differs.
    order = np.argsort(place, kind="stable")
    side, ids = side_of[order], np.concatenate([a_ids, b_ids])[order]
    mark = np.where(np.diff(place[order], append=place[order[-1]] + 1) == 0, 1, 2 + side)
    mark[-1] = 0
    shown = np.where(side == 0, a.shown[(mark * len(a.tokens) + ids) * (side == 0)], b.shown[(mark * len(b.tokens) + ids) * (side == 1)])
    return shown.tobytes().translate(None, b"\0")


def _align(aligner: Aligner, ids: tuple[np.ndarray, np.ndarray] | None) -> tuple[tuple[int, int, int, int], bytes, np.ndarray, np.ndarray]:
    """(counts, groups, distinct pairs, how often each is linked) of one text."""
    if ids is None:
        nothing = np.zeros(0, np.int64)
        return (0, 0, 0, 0), b"", nothing, nothing
    a_ids, b_ids = ids
    a_token, b_token, cut = overlaps(aligner.a.owners(a_ids), aligner.b.owners(b_ids))
    pairs, times = np.unique(a_ids[a_token] << B_BITS | b_ids[b_token], return_counts=True)
    groups = group_text(aligner.a, aligner.b, a_ids, b_ids, a_token, b_token, cut)
    return (len(a_ids), len(b_ids), int(cut.sum()), len(a_token)), groups, pairs, times


def aligned_blocks(df: DataFrame, text: str, keep: Sequence[str], full: bool = False, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Each document's alignment, its block, its distinct pairs and their times."""
    fields = FULL if full else FIELDS
    schema = T.StructType([*(df.select(F.col(f"`{c}`")).schema[0] for c in keep), *fields.fields, *_CODES.fields])
    arrow = to_arrow_schema(T.StructType([*fields.fields, *_CODES.fields]))
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY))
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                size, end = 0, at
                while end < batch.num_rows and (end == at or size < CHUNK):
                    size += len(texts[end].as_py() or "")
                    end += 1
                made: dict[str, list] = {n: [] for n in arrow.names}
                for ids in aligner.encode(texts.slice(at, end - at).to_pylist()):
                    counts, groups, pairs, times = _align(aligner, ids)
                    if held and held + counts[3] > BLOCK:
                        block, held = block + 1, 0
                    held += counts[3]
                    for name, value in zip(FIELDS.names, counts):
                        made[name].append(value)
                    made["groups_sha256"].append(hashlib.sha256(groups).hexdigest() if groups else "")
                    if full:
                        made["groups"].append(groups.decode())
                    made["__block"].append(block)
                    made["__pairs"].append(pairs)
                    made["__times"].append(times.astype(np.int32))
                columns = [*batch.slice(at, end - at).columns[:-1], *(pa.array(made[f.name], f.type) for f in arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at = end

    return source.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents a pair is linked, and whether no pair of the same id of A is in more."""
    counts = blocks.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = counts.withColumn("a", F.shiftright("pair", B_BITS))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align_tokenizers(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), full: bool = False, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Counts of tokens, groups and links, how common the links are, and the digest of the groups, for each row.

    ``n_best``: links whose pair is in as many documents as any pair of the same id of A. ``count_sum``: the documents of each
    link's pair, summed over links. With ``full`` also the groups themselves. ``a_path`` and ``b_path`` are vocabulary files that
    every executor can open: ranks of a byte-level BPE, and a model of pieces.
    """
    fields = FULL if full else FIELDS
    results = {*fields.names, "n_best", "count_sum"}
    keep = [c for c in dict.fromkeys(keep) if c not in results and not c.startswith("__")]
    blocks = written(aligned_blocks(df, text, keep, full, a_path, b_path), "aligned")
    wanted = blocks.select(F.col("__block").alias("of_block"), F.explode("__pairs").alias("pair")).distinct()
    known = wanted.join(pair_counts(blocks), "pair")
    kept = [*keep, *fields.names]
    schema = T.StructType([*(blocks.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def fill(documents: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(codes := counts.column("pair").to_numpy())
        codes, sums = codes[order], counts.column("documents").to_numpy()[order]
        best = counts.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for pairs, times in zip(documents.column("__pairs").to_pylist(), documents.column("__times").to_pylist()):
            at, n = np.searchsorted(codes, np.array(pairs, np.int64)), np.array(times, np.int64)
            n_best.append(int((n * best[at]).sum()) if len(n) else 0)
            count_sum.append(int((n * sums[at]).sum()) if len(n) else 0)
        columns = [*documents.select(kept).columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
        return pa.table(columns, names=schema.names)

    return blocks.groupBy("__block").cogroup(known.groupBy("of_block")).applyInArrow(fill, schema)
