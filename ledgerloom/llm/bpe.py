"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring symbols that never stand side by side inside any token of the vocabulary can never be merged, nor can
a merge reach across them: a cut between them is certain. Every word is cut at all such places, the fragments are
encoded independently, and their ids are concatenated. The result equals that of the whole word's merges.

Edge cases: a null text counts as empty (no ids). Special tokens' strings inside a text become their ids, as the public
library does. Whole texts are encoded; fragments of any length take n log n steps. Repeated rows give repeated results,
an empty table gives an empty table, and other columns are ignored unless kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import Bounded, map_texts, vocabulary_path

VOCABULARY = "word_bpe_49k.json"

_BEYOND = re.compile("[^\0-\u052f]")

FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
FULL = T.StructType([*FIELDS.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder for a byte-level vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # Token pairs as one integer; no vocabulary of this kind has ids of more than 20 bits.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], (rank, self.vocab[a + b]))
        library = tokenizers.Tokenizer.from_file(path)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normaliser = library.normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), behavior="removed", invert=True)
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.joinable = self._joinable()
        self.encoded = Bounded(self._word, 500_000, 64)

    def _symbols(self, token: str) -> list[int]:
        closed = bool(self.end) and token.endswith(self.end)
        letters = list(token.removesuffix(self.end) if closed else token)
        if closed and letters:
            letters[-1] += self.end
        return [self.vocab[x] for x in letters]

    def _joinable(self) -> set[int]:
        """Pairs of neighbouring symbols inside some token; every other pair is a certain cut."""
        pairs: set[int] = set()
        for token in self.vocab:
            symbols = self._symbols(token)
            pairs.update(a << 20 | b for a, b in zip(symbols, symbols[1:]))
        return pairs

    def cut(self, symbols: list[int]) -> Iterable[list[int]]:
        """The fragments of a word between certain cuts."""
        joinable, start, before = self.joinable, 0, symbols[0]
        for i, symbol in enumerate(symbols):
            if i and before << 20 | symbol not in joinable:
                yield symbols[start:i]
                start = i
            before = symbol
        yield symbols[start:] if start else symbols

    def fragment(self, part: list[int]) -> list[int]:
        """Ids of one fragment: the merge of least rank first, leftmost on ties."""
        if len(part) > 40:
            return self._long(part)
        merges = self.merges
        none = (1 << 30, 0)
        found = [merges.get(a << 20 | b, none) for a, b in zip(part, part[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            part[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = merges.get(part[i] << 20 | part[i + 1], none)
            if i:
                found[i - 1] = merges.get(part[i - 1] << 20 | part[i], none)
        return part

    def _long(self, symbols: list[int]) -> list[int]:
        """The same by a heap, in n log n steps."""
        n = len(symbols)
        part: list[int] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i) for i in range(n - 1) if (m := merges.get(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if part[i] >= 0 else n
            if j >= n or (m := merges.get(part[i] << 20 | part[j])) is None or m[0] != rank:
                continue
            part[i], part[j] = m[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get(part[i] << 20 | part[after[i]]):
                    heapq.heappush(heap, (m[0], i))
            if before[i] >= 0 and (m := merges.get(part[before[i]] << 20 | part[i])):
                heapq.heappush(heap, (m[0], before[i]))
        return [p for p in part if p >= 0]

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        inner = self.inner
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if len(symbols) == 1:
            return symbols
        return [i for part in self.cut(symbols) for i in self.fragment(part)]

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.word_ids(word)
        tokens = self.tokens
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([tokens[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Normalised words. Beyond U+052F the library's own Unicode tables decide, which can be of another version."""
        if not _BEYOND.search(text):
            # Each letter is lowered by itself: a final capital sigma is no special case.
            return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and what they decode to."""
        if not text:
            return b"", ""
        ids, shown = [], []
        pieces = self.specials.split(text) if self.specials and "<|" in text else (text,)
        for piece in pieces:
            if piece in self.special:
                ids.append(int(self.special[piece]).to_bytes(4, "little"))
                shown.append(piece)
                continue
            encoded = self.encoded
            made = [encoded[word] for word in self.split(piece)]
            ids += [a for a, _ in made]
            shown += [b for _, b in made]
        return b"".join(ids), " ".join(shown)

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary has no decoder of its own: tokens are shown one after another, parted by a space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def bpe_round_trip(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: str | None = None, full: bool = False) -> DataFrame:
    """Token count and digests for each row; with ``full`` also the ids and the decoded text.

    ``vocabulary`` is a path to a vocabulary file that every executor can open; by default the public one.
    """
    fields = FULL if full else FIELDS

    def make():
        codec = Codec(vocabulary or vocabulary_path(VOCABULARY))

        def work(texts):
            out = {name: [] for name in fields.names}
            for x in texts:
                ids, shown = codec.encode(x)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if full:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    shown = codec.decode(np.frombuffer(ids, "<u4").tolist())
                    out["decoded"].append(shown)
                out["decoded_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
            return out

        return work

    return map_texts(df, text, make, fields, keep)
