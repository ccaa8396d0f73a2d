"""What the operators of this subpackage share: per-text workers, vocabulary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[Sequence[str | None]], dict[str, list]]], fields: T.StructType, keep: Sequence[str]) -> DataFrame:
    """One output row for each input row: the columns ``keep`` as they are, then ``fields``.

    ``make`` runs once in each Python worker and returns a function from a list of texts to lists of values by
    field name. A kept column whose name clashes with a field is dropped in favour of the field. Rows go through in
    Arrow batches, so memory is bounded by a batch, whatever the table's size.
    """
    names = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields.fields])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = work(part.column(part.num_columns - 1).to_pylist())
                columns = [*part.columns[:-1], *(pa.array(made[f.name], f.type) for f in arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrow.names])

    return source.mapInArrow(run, schema)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken file."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Bounded(dict):
    """A memo of ``make(key)`` of bounded memory: it starts anew beyond ``most`` keys, and long keys aren't kept."""

    def __init__(self, make: Callable, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
