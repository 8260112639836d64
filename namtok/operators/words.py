"""Words of texts by script runs, in Arrow batches: no row for each token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namtok.functions.charclass import KINDS, RUNS

#: Texts that Python holds as objects at once, and different words that a task counts before it sends them.
ROWS, HELD = 500, 200_000


def in_python(pattern: str) -> str:
    """A pattern of ``charclass`` as Python writes it."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern)


#: What texts say with: runs of these kinds (their classes share no character).
CONTENT = "|".join(f"[{KINDS[k]}]+" for k in ("Number", "Thai", "Latin"))
_CONTENT, _RUNS = re.compile(in_python(CONTENT)), re.compile(in_python(RUNS))
#: By byte: 1 for ASCII letters, 2 for ASCII digits; and what leaves only those, parted by spaces.
_CLASS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 0 for b in range(128)] + [0] * 128, np.uint8)
_PARTED = bytes(b if _CLASS[b] else 32 for b in range(256))


def content_words(text: str) -> list[str]:
    """The runs of CONTENT. Only where a byte may lead a Thai or full-width character is the pattern needed."""
    data = text.encode()
    if b"\xe0" in data or b"\xef" in data:
        return _CONTENT.findall(text)
    values = np.frombuffer(data, np.uint8)
    kinds = _CLASS[values]
    joints = np.flatnonzero((kinds[1:] | kinds[:-1]) == 3)
    if joints.size:
        data = np.insert(values, joints + 1, 32).tobytes()
    return data.translate(_PARTED).decode("ascii").split()


def content_in_order(texts: list[str]) -> list[str]:
    """The runs of CONTENT of texts that share an id, by their place among all runs of a text."""
    if len(texts) == 1:
        return content_words(texts[0])
    return [w for _, w in sorted((i, w) for t in texts for i, w in enumerate(_RUNS.findall(t)) if _CONTENT.match(w))]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) of the content words of all texts; a task sends what it has counted whenever it holds HELD words."""

    def count(batches):
        found = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "freq"])

        for batch in slices(batches):
            found.update(content_words("\n".join(t for t in batch.column(0).to_pylist() if t)))
            if len(found) > HELD:
                yield sent()
                found = Counter()
        yield sent()

    return df.select(text_col).mapInArrow(count, "word string, freq bigint").groupBy("word").agg(F.sum("freq").alias("freq"))


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once: in the folder of ``spark.checkpoint.dir``, or kept by the executors where that is unset."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
