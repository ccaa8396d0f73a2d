"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy on ``TRAIN_WINDOWS`` generated windows with labelled spans (a fixed seed; written forms that
the patterns miss: at-signs spelled out, telephone numbers without a plus, spaced or bracketed addresses, beside dates,
prices, versions and other numbers that are nobody's). Windows overlap by half. The scores of both windows that a character lies in
are added, weighted by how far inside each it lies, and one best tag sequence is decoded over each whole stretch of text, so no
window's border shows. Runs of tags are spans; those that are plausible (digits, checksum, address parts) are added
where no pattern's span lies.

A span that is added holds a digit or an at-sign (spelled or not) and at most ``LONGEST`` characters. Stretches
reach further than that from every such character, and text between them is not decoded: nothing could be added there.

Edge cases: a null text counts as empty; whole texts are read; repeated rows give repeated results; an empty table gives an
empty table; other columns are ignored unless kept.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.llm.common import map_texts
from ledgerloom.llm.tagger import Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: No plausible span is longer.
LONGEST = 96
#: The classifier's bounded training sample and its passes.
TRAIN_WINDOWS = 3_000
TRAIN_STEPS = 450

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
_AT = re.compile(r"@|[\[(]at[\])]")
_DOT = re.compile(r"\.|[\[(]dot[\])]")

FIELDS = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the four patterns, by kind, then start."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not any(d in text for d in "0123456789"):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


# Labelled examples.

_SYLLABLES = "an be ca de er fi go ha in jo ka le mi no or pa qu re so ti un vé wo xi yá zö the ing ción eau schn".split()
_TLDS = ("com", "org", "net", "de", "fr", "co.uk", "io", "es")


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    head = rng.choice("3456") + _digits(rng, rng.choice((12, 14, 14, 14)))
    number = next(head + d for d in "0123456789" if luhn(head + d))
    mark = rng.choice(("", " ", "-", ".", " - "))
    return mark.join(number[i : i + 4] for i in range(0, len(number), 4))


def _email(rng: random.Random) -> str:
    local = rng.choice((".", "_", "")).join(_word(rng) for _ in range(rng.randint(1, 2))) + rng.choice(("", str(rng.randint(0, 99))))
    host = _word(rng) + rng.choice(("", str(rng.randint(1, 9))))
    at, dot = rng.choice((("@", "."), ("@", "."), (" @ ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" [at] ", ".")))
    return f"{local}{at}{host}{dot}{rng.choice(_TLDS)}"


def _ip(rng: random.Random) -> str:
    return rng.choice((".", ".", " . ", "[.]")).join(str(rng.randint(0, 255)) for _ in range(4))


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 99)} {a} {b}{c}", f"0{a} {b}{c}", f"00{rng.randint(20, 99)} {a} {b} {c}"))


def _other(rng: random.Random) -> str:
    """Numbers that are nobody's."""
    n = rng.randint
    return rng.choice(
        (
            str(n(0, 9999)),
            f"{n(1, 12)}:{n(10, 59)}",
            f"{n(1900, 2030)}-{n(10, 12)}-{n(10, 28)}",
            f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2030)}",
            f"{n(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}",
            f"${n(1, 999)}.{_digits(rng, 2)}",
            f"{n(0, 9)}.{n(0, 20)}.{n(0, 9)}",
            f"{n(1, 99)}%",
            f"#{_digits(rng, n(4, 10))}",
            f"{_digits(rng, n(5, 10))}",
            f"{n(10, 99)}-{n(10, 99)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 32, 40)))),
            f"978-{n(0, 9)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{n(0, 9)}",
            f"Version {n(1, 9)}.{n(0, 9)}",
            f"@{_word(rng)}",
        )
    )


def labelled(seed: int, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with their spans (kind's place in KINDS, start, end)."""
    rng = random.Random(seed)
    makers = (_email, _ip, _card, _phone)
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 16:
            what = rng.random()
            if what < 0.22:
                kind = rng.randrange(4)
                made = makers[kind](rng)
                spans.append((kind, len(text), len(text) + len(made)))
            elif what < 0.4:
                made = _other(rng)
            else:
                made = _word(rng)
                made = made.capitalize() if rng.random() < 0.15 else made
            text += made + rng.choice((" ", " ", " ", " ", ", ", ". ", "\n", "*** ", ") ", " ("))
        out.append((text, spans))
    return out


def window_of(text: str, spans: Sequence[tuple[int, int, int]], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of one window; tag 0 is none, 2k + 1 begins kind k, 2k + 2 goes on."""
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 * kind + 2
        tags[a] = 2 * kind + 1
    ids = char_ids(text)[start : start + WINDOW]
    return np.pad(ids, (0, WINDOW - len(ids))), np.pad(tags[start : start + WINDOW], (0, WINDOW - len(ids)))


def training_set(examples: Sequence[tuple[str, Sequence[tuple[int, int, int]]]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    made = [window_of(text, spans, rng.randint(0, max(0, min(16, len(text) - WINDOW)))) for text, spans in examples]
    return np.stack([a for a, _ in made]), np.stack([b for _, b in made])


def train(seed: int = 7, windows: int = TRAIN_WINDOWS, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """The tagger's arrays, the same for the same arguments; a few ten kilobytes."""
    tagger = Tagger(2 * len(KINDS) + 1, seed=seed)
    tagger.fit(*training_set(labelled(seed, windows)), steps=steps)
    return tagger.params


_TRAINED: dict[tuple, dict[str, np.ndarray]] = {}


def trained(spark: SparkSession, seed: int = 7, windows: int = TRAIN_WINDOWS, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """``train`` in one task of the cluster, where numpy has one thread, which suits its many small products; kept by session."""
    key = (spark.sparkContext.applicationId, seed, windows, steps)
    if key not in _TRAINED:

        def run(batches):
            for _ in batches:
                pass
            params = train(seed, windows, steps)
            yield pa.RecordBatch.from_arrays([pa.array(list(params)), pa.array([list(v.shape) for v in params.values()]), pa.array([v.astype(np.float32).tobytes() for v in params.values()])], names=["name", "shape", "data"])

        rows = spark.range(0, 1, 1, 1).mapInArrow(run, "name string, shape array<bigint>, data binary").collect()
        _TRAINED[key] = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in rows}
    return _TRAINED[key]


def plausible(kind: int, string: str) -> bool:
    if len(string) > LONGEST:
        return False
    digits = _NOT_DIGIT.sub("", string)
    if kind == 0:
        at = _AT.search(string)
        return bool(at and at.start() > 0 and _DOT.search(string, at.end()) and string[-1].isalpha() and string.count("\n") == 0)
    if kind == 1:
        parts = re.split(r"[^0-9]+", string)
        return len(parts) == 4 and all(parts) and all(map(_small, parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in string)
    return 9 <= len(digits) <= 15 and not any(c.isalpha() for c in string) and (string[0] in "+(0" or len(re.findall("[0-9]+", string)) >= 3)


class Finder:
    """Finds spans in many texts at once; built once in each worker."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.tagger = Tagger(2 * len(KINDS) + 1, hidden=params["hf"].shape[0], params=params)

    def stretches(self, text: str, everywhere: bool) -> list[tuple[int, int]]:
        """First and last window of each stretch; window k begins at (k - 1) * STRIDE."""
        last = (len(text) - 1) // STRIDE + 1
        if everywhere:
            return [(0, last)] if text else []
        reach = -(-LONGEST // STRIDE) + 1
        out: list[list[int]] = []
        for m in _TRIGGER.finditer(text):
            k = m.start() // STRIDE
            a, b = max(0, k - reach), min(last, k + 1 + reach)
            if out and a <= out[-1][1] + 1:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def scored(self, texts: Sequence[str], everywhere: bool) -> list[tuple[int, int, np.ndarray]]:
        """(text, start, scores) of each stretch: the weighted mean of its windows' tag scores; 36 bytes for each character."""
        inside = np.minimum(np.arange(WINDOW) + 0.5, WINDOW - 0.5 - np.arange(WINDOW)).astype(np.float32)[:, None]
        out, waiting = [], []

        def flush() -> None:
            scores = self.tagger.emissions(np.stack([w for _, w in waiting])).transpose(1, 0, 2) * inside
            for (goal, _), own in zip(waiting, scores):
                goal += own
            waiting.clear()

        ends = []
        for n, text in enumerate(texts):
            ranges = self.stretches(text, everywhere)
            if not ranges:
                continue
            # Windows may begin before the text and end after it; what lies outside is padding.
            ids = np.pad(char_ids(text), (STRIDE, WINDOW + STRIDE))
            for a, b in ranges:
                total = np.zeros(((b - a + 2) * STRIDE, self.tagger.n_tags), np.float32)
                for k in range(a, b + 1):
                    waiting.append((total[(k - a) * STRIDE : (k - a) * STRIDE + WINDOW], ids[k * STRIDE : k * STRIDE + WINDOW]))
                    if len(waiting) == 512:
                        flush()
                ends.append((n, (a - 1) * STRIDE, total))
        if waiting:
            flush()
        for n, start, total in ends:
            # The halves at a stretch's ends lie in one window; elsewhere the weights add up to half a window.
            total[:STRIDE] *= STRIDE / inside[:STRIDE]
            total[-STRIDE:] *= STRIDE / inside[STRIDE:]
            total /= STRIDE
            lo, hi = max(0, -start), min(len(total), len(texts[n]) - start)
            out.append((n, start + lo, total[lo:hi]))
        return out

    def tagged(self, texts: Sequence[str], everywhere: bool = False) -> list[list[tuple[int, int, int]]]:
        """The tagger's own spans; texts are scored a million characters at a time."""
        parts, group, size = [], [], 0
        for n, text in enumerate(texts):
            group.append(n)
            size += len(text)
            if size < 1_000_000 and n + 1 < len(texts):
                continue
            for at, start, scores in self.scored([texts[i] for i in group], everywhere):
                places = np.flatnonzero(self.tagger.open_places(scores))
                if len(places):
                    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                        parts.append((group[at], start + int(run[0]), scores[run[0] : run[-1] + 1].copy()))
            group, size = [], 0
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        parts.sort(key=lambda p: len(p[2]))
        at = 0
        while at < len(parts):
            # Runs of similar lengths are decoded together.
            longest = max(16, 2 * len(parts[at][2]))
            some = [p for p in parts[at : at + 512] if len(p[2]) <= longest]
            at += len(some)
            scores = np.full((len(some), max(len(p[2]) for p in some), self.tagger.n_tags), -1e6, np.float32)
            scores[:, :, 0] = 0
            for row, (_, _, own) in zip(scores, some):
                row[: len(own)] = own
            for (n, start, own), tags in zip(some, self.tagger.decode(scores)):
                out[n] += runs(tags[: len(own)], start)
        return [sorted(spans, key=lambda s: s[1]) for spans in out]

    def spans(self, texts: Sequence[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """(pattern spans, all spans) of each text, by kind, then start."""
        texts = [t or "" for t in texts]
        out = []
        for text, tagged in zip(texts, self.tagged(texts)):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            starts = [a for a, _ in taken]
            reached = list(itertools.accumulate((b for _, b in taken), max))
            added = []
            for kind, a, b in tagged:
                string = text[a:b]
                a += len(string) - len(string.lstrip(" .,-\n"))
                b -= len(string) - len(string.rstrip(" .,-\n("))
                before = bisect.bisect_left(starts, b)
                if a < b and not (before and reached[before - 1] > a) and plausible(kind, text[a:b]):
                    added.append((kind, a, b))
            out.append((base, sorted(base + added)))
        return out


def runs(tags: np.ndarray, start: int) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of a tag sequence whose first tag is at ``start``."""
    out, now, first = [], -1, 0
    for i, tag in enumerate(tags.tolist()):
        kind = (tag - 1) // 2 if tag else -1
        if now >= 0 and (kind != now or tag % 2 == 1):
            out.append((now, start + first, start + i))
            now = -1
        if kind >= 0 and now < 0:
            now, first = kind, i
    if now >= 0:
        out.append((now, start + first, start + len(tags)))
    return out


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), seed: int = 7) -> DataFrame:
    """Counts and spans for each row."""
    params = trained(df.sparkSession, seed)

    def make():
        finder = Finder(params)

        def work(texts):
            out = {name: [] for name in FIELDS.names}
            for base, spans in finder.spans(texts):
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["n_added"].append(len(spans) - len(base))
            return out

        return work

    return map_texts(df, text, make, FIELDS, keep)
