"""Secret scans: fixed patterns plus a token-efficiency test.

A run of 20 or more credential characters that a tiktoken vocabulary can only write with few characters per token is a
random string; words, even unusual ones, take fewer tokens. Known digests (hexadecimal of a digest's length, UUIDs), numbers
and identifiers (words joined by separators or by capitals, which by themselves take few tokens) are excluded.
Where a run as a whole isn't random, as in paths and host names, its segments between separators are judged by themselves, and
so are stretches of 20 characters at every token, within a segment or over several.

Edge cases: a null text counts as empty; texts are scanned whole; patterns never retry inside a failing match. Repeated
rows give repeated results, an empty table gives an empty table, and other columns are ignored unless kept.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import map_texts, tiktoken_ranks, vocabulary_path

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Strings shorter than this hold too little evidence for the ratio test.
MIN_LENGTH = 20
#: Characters per token at or below which a string counts as random. Base64 and mixed alphabets measure 1.2 to 1.8.
MAX_RATIO = 1.95
#: The same for stretches, which are many and so need more evidence. Base62 and base32 measure at most 1.75 in 99 of 100 cases.
MAX_STRETCH = 1.75
#: Least share of letters in a stretch; fewer are dates and numbers.
MIN_LETTERS = 0.25
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{%d,}={0,2}" % MIN_LENGTH)
#: Strings are encoded in pieces of so many characters: linear in the length, at most one token more for each piece.
_PIECE = 256
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SEGMENT = re.compile(r"[A-Za-z0-9+=]+")
_PART = re.compile(r"[0-9]+|[A-Z]?[a-z]+|[A-Z]+")

FIELDS = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_random", T.LongType()),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three fixed patterns."""
    found = []
    low = text.lower()
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def known(string: str) -> bool:
    """Whether a run is a digest or made of numbers, which say nothing secret by themselves."""
    if _UUID.fullmatch(string) or len(string) in DIGEST_LENGTHS and _ALL_HEX.fullmatch(string):
        return True
    return all(p.isdigit() for p in _PART.findall(string))  # numbers, dates, versions


class Scanner:
    """Finds spans in texts; built once in each worker."""

    def __init__(self, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO):
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken_ranks(vocabulary_path(vocabulary)), special_tokens={})
        self.max_ratio = max_ratio

    def tokens(self, string: str) -> int:
        return sum(len(self.encoding.encode_ordinary(string[i : i + _PIECE])) for i in range(0, len(string), _PIECE))

    def identifier(self, string: str) -> bool:
        """Whether a run is made of words: few parts for its letters, few numbers between them, and few tokens for each part."""
        parts = _PART.findall(string)
        words = [p for p in parts if not p.isdigit()]
        letters = sum(map(len, words))
        return letters >= 4 * len(words) and len(parts) <= 2 * len(words) + 1 and letters > self.max_ratio * sum(map(self.tokens, words))

    def random(self, string: str) -> bool:
        if len(string) < MIN_LENGTH or known(string) or len(string) > self.max_ratio * self.tokens(string):
            return False
        return not self.identifier(string)

    def inner(self, string: str) -> list[tuple[int, int]]:
        """Random parts of a run that isn't random as a whole: (start, end), not overlapping."""
        segments = [m.span() for m in _SEGMENT.finditer(string)]
        hidden = [m.span() for m in _UUID.finditer(string)]
        hidden += [(a, b) for a, b in segments if b - a >= MIN_LENGTH and known(string[a:b])]
        found, pieces, at = [], [], [[]]
        for a, b in segments:
            if any(a < d and c < b for c, d in hidden):
                at.append([])  # stretches don't go over digests
                continue
            if b - a >= MIN_LENGTH and self.random(string[a:b]):
                found.append((a, b))
                at.append([])
                continue
            sizes = [len(self.encoding.decode_single_token_bytes(t)) for i in range(a, b, _PIECE) for t in self.encoding.encode_ordinary(string[i : min(b, i + _PIECE)])]
            pieces.append((a, b, (b - a) > self.max_ratio * len(sizes)))
            for size in sizes:
                at[-1].append((a, a + size))
                a += size
        for tokens in at:
            first = length = 0
            for last, (_, end) in enumerate(tokens):
                length += tokens[last][1] - tokens[last][0]
                while length - (tokens[first][1] - tokens[first][0]) >= MIN_LENGTH:
                    length -= tokens[first][1] - tokens[first][0]
                    first += 1
                if MIN_LENGTH <= length <= MAX_STRETCH * (last - first + 1):
                    part = string[tokens[first][0] : end]
                    if sum(map(str.isalpha, part)) >= MIN_LETTERS * length and not self.identifier(part):
                        found.append((tokens[first][0], end))
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        # A random segment is taken whole where a stretch holds part of it.
        for span in merged:
            for a, b, wordy in pieces:
                if not wordy and a < span[1] and span[0] < b:
                    span[:] = min(a, span[0]), max(b, span[1])
        out: list[tuple[int, int]] = []
        for a, b in merged:
            if out and a < out[-1][1]:
                c, d = out.pop()
                a, b = min(a, c), max(b, d)
            out.append((a, b))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        found = base_spans(text)
        starts = [a for a, _, _ in found]
        reached = list(itertools.accumulate((b for _, _, b in found), max))
        random = []
        for m in _RUN.finditer(text):
            string = m.group()
            start = m.start() + len(string) - len(string.lstrip("._-/"))
            string = string.strip("._-/")
            if len(string) < MIN_LENGTH or known(string):
                continue
            parts = [(0, len(string))] if self.random(string) else self.inner(string)
            for a, b in ((start + a, start + b) for a, b in parts):
                before = bisect.bisect_right(starts, a)
                if not (before and reached[before - 1] >= b):  # no pattern's span holds it
                    random.append((a, 3, b))
        return sorted(found + random)


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None, spans: Sequence[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by a mark; overlapping spans are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def scan_secrets(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO, redact: bool = False) -> DataFrame:
    """Counts and spans for each row; with ``redact`` also ``redacted_text``."""
    fields = T.StructType([*FIELDS.fields, *([T.StructField("redacted_text", T.StringType())] if redact else [])])

    def make():
        scanner = Scanner(vocabulary, max_ratio)

        def work(texts):
            out = {name: [] for name in fields.names}
            for x in texts:
                spans = scanner.spans(x)
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
                out["n_random"].append(len(spans) - len(base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                if redact:
                    out["redacted_text"].append(redacted(x, spans))
            return out

        return work

    return map_texts(df, text, make, fields, keep)
