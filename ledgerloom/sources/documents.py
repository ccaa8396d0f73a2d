"""Receipts from text, PDF, recognised words and model replies; inbox classification. Unreadable input becomes rows with a reason."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import parse_cents
from ledgerloom.scratch import written

# Fixed values.
LOW_CONFIDENCE, LOW_SHARE, FEWEST_WORDS = 60, 0.2, 8
OPERATOR_FLOOR = 20
STREAM_CAP = 64 << 20
HEAD = 4096
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp", "heic")
TEXTS = ("txt", "md", "text")
STATEMENTS = ("csv", "ofx", "qfx", "txt")

_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)
_SHOWN = re.compile(rb"\(((?:\\.|[^()\\])*)\)\s*(?:Tj|')|\[((?:\\.|[^\]\\])*)\]\s*TJ", re.S)
_PIECE = re.compile(rb"\(((?:\\.|[^()\\])*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_streams(data: bytes) -> Iterator[bytes]:
    """The content streams, inflated where compressed, each up to a cap."""
    for m in _STREAM.finditer(data):
        try:
            yield zlib.decompressobj().decompress(m.group(1), STREAM_CAP)
        except zlib.error:
            yield m.group(1)[:STREAM_CAP]


def pdf_string(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        c = m.group(1)
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _NAMED.get(c, c)

    return _ESCAPE.sub(one, raw).decode("latin-1")


def pdf_kind(data: bytes) -> str:
    """``text``, ``scan`` or ``empty``: drawn strings against images. A few strings on a page with an image are a stamp on a scan."""
    shown = sum(len(_SHOWN.findall(s)) for s in pdf_streams(data))
    image = b"/Subtype/Image" in data.replace(b" ", b"")
    if image and shown < OPERATOR_FLOOR:
        return "scan"
    return "text" if shown else "empty"


def pdf_text(data: bytes) -> str:
    """Drawn strings, one for each line."""
    out = []
    for stream in pdf_streams(data):
        for m in _SHOWN.finditer(stream):
            out.append(pdf_string(m.group(1)) if m.group(1) is not None else "".join(pdf_string(p) for p in _PIECE.findall(m.group(2))))
    return "\n".join(out)


def read_pdf(data: bytes) -> tuple[str, str | None]:
    """(text, reason): the text layer of a PDF, or why there is none."""
    if not data.startswith(b"%PDF"):
        return "", "not a PDF"
    kind = pdf_kind(data)
    if kind != "text":
        return "", {"scan": "a scan without a text layer", "empty": "nothing is drawn"}[kind]
    text = pdf_text(data)
    return (text, None) if text.strip() else ("", "the text layer is blank")


def lines_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, line, text): recognised words of each line, left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("left", "text")))
    return words.groupBy("doc_id", "line").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def assemble_words(words: DataFrame) -> DataFrame:
    """(receipt_id, text, degraded, confidence, reader) from (doc_id, text, confidence, left, top, width, height, line)."""
    low = F.count_if(F.col("confidence") < LOW_CONFIDENCE) / F.count("*")
    facts = words.groupBy("doc_id").agg(((low > LOW_SHARE) | (F.count("*") < FEWEST_WORDS)).alias("degraded"), F.bround(100 * (1 - low), 1).alias("confidence"))
    lines = lines_of_words(words).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return facts.join(lines, "doc_id").select(F.col("doc_id").alias("receipt_id"), "text", "degraded", "confidence", F.lit("ocr").alias("reader"))


def read_replies(replies: DataFrame) -> DataFrame:
    """Receipts from a model's replies (path, raw): the first JSON object; what isn't a number is left out; ``generated`` is true."""
    fields = ("subtotal", "tax", "tip", "discount", "fees", "total")
    schema = ", ".join(f"{f} string" for f in (*fields, "merchant", "currency", "date"))
    parsed = replies.select("path", F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), schema).alias("j"))
    amounts = [parse_cents(F.col(f"j.{f}")).alias(f"{f}_cents") for f in fields]
    return parsed.filter(F.col("j").isNotNull()).select(F.col("path").alias("receipt_id"), *amounts, F.coalesce("j.merchant", F.lit("")).alias("merchant"), "j.currency", F.lit(True).alias("generated"), F.lit("vision").alias("reader"))


INBOX = "inbox string, path string, kind string, reason string, digest string, text string, degraded boolean, reader string"


def _opened(path: str, data: bytes, read: bool) -> tuple:
    """(inbox, path, kind, reason, digest, text, degraded, reader) of one file."""
    from ledgerloom.sources.statements import find_header

    inbox, _, name = path.rpartition("/")
    suffix = name.rpartition(".")[2].lower() if "." in name else ""
    text, degraded, reader = None, None, None
    if name.startswith("."):
        kind, reason = "ignored", "hidden"
    elif suffix not in (*STATEMENTS, *TEXTS, *IMAGES, "pdf"):
        kind, reason = "ignored", "unknown kind of file"
    else:
        head = data[:HEAD].decode("utf-8", "replace")
        header = find_header(head) if suffix in STATEMENTS else None
        statement = suffix in STATEMENTS and ("<STMTTRN>" in head.upper() or (header is not None and "date" in header[2]))
        kind, reason = ("statement" if statement else "receipt"), None
    if read and kind == "receipt":
        if suffix in IMAGES:
            reason = "no engine for images is installed"
        elif suffix == "pdf":
            text, reason = read_pdf(data)
            degraded, reader = reason is not None, "pdf"
        else:
            # A table that is no statement is read as text, which nobody should trust.
            text, degraded, reader = data.decode("utf-8", "replace"), suffix not in TEXTS, "text"
    return inbox, path, kind, reason, hashlib.sha256(data).hexdigest(), text, degraded, reader


def read_inbox(files: DataFrame, read: bool = True) -> DataFrame:
    """(inbox, path, kind, reason, digest, text, degraded, reader) from (path, content): each file is opened once.

    ``kind``: statement, receipt or ignored; what a file holds decides, not its name alone. Receipts that can be read have a text; the
    others have a reason. Without ``read`` files are only told apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_opened(p, bytes(c or b""), read) for p, c in zip(batch["path"], batch["content"])], columns=[c.split(" ")[0] for c in INBOX.split(", ")])

    return files.select("path", "content").mapInPandas(run, INBOX)


def classify_inbox(files: DataFrame) -> DataFrame:
    """(inbox, path, kind, reason) from (path, content)."""
    return read_inbox(files, read=False).select("inbox", "path", "kind", "reason")


def copies(opened: DataFrame) -> DataFrame:
    """(path, digest, same_as): files that hold the same bytes as one whose path comes before, and the first such path."""
    first = F.min("path").over(Window.partitionBy("digest"))
    return opened.select("path", "digest", first.alias("same_as")).filter("path != same_as")


def inbox_problems(classified: DataFrame) -> DataFrame:
    """(inbox, statements, problem): an inbox needs exactly one statement."""
    n = F.count_if(F.col("kind") == "statement")
    return classified.groupBy("inbox").agg(n.alias("statements"), F.when(n == 0, F.lit("no statement")).when(n > 1, F.lit("more than one statement")).alias("problem"))


def receipts_of(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipt texts, unreadable) of ``read_inbox``."""
    receipts = opened.filter("kind = 'receipt'").withColumnRenamed("path", "receipt_id")
    return receipts.filter(F.col("reason").isNull()).select("receipt_id", "text", "degraded", "reader"), receipts.filter(F.col("reason").isNotNull()).select("receipt_id", "reason")


def read_receipts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(receipt texts, unreadable): every receipt under a path; images need a recogniser that isn't here. Files are read once, into a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return receipts_of(written(read_inbox(files), "inbox"))
