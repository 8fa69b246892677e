"""Archive files as streams of bytes, read by Spark in pieces and put together in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch of records is passed on when it holds so many bytes of payload, or so many records.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000

#: How archives are written. Pages shrink nearly as well at the fastest level, for a quarter of the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, piece) of all files below ``path``, the pieces of a file in order and in one task.

    Compressed files (``*.gz``) are never split, so they are read in pieces as long as the
    stretch between two separators; the separator at the end of a piece is left out. Files named
    ``*.arc`` or ``*.warc`` are read whole and must be smaller than 2 GB. Others are left alone.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    file = F.xxhash64("_metadata.file_path").alias("file")
    text = reader.option("lineSep", separator).option("pathGlobFilter", "*.gz").text(path)
    plain = reader.option("pathGlobFilter", "*.{arc,warc}").format("binaryFile").load(path)
    return text.select(file, F.col("value").cast("binary").alias("piece")).unionByName(
        plain.select(file, F.col("content").alias("piece")))


def files(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each file of a task with its bytes, in chunks of a batch or less."""

    def chunks():
        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for low, high in zip(cuts, cuts[1:]):
                held = batch.column(1).slice(low, high - low).to_pylist()
                held.append(b"")
                yield int(file[low]), separator.join(held)

    for file, group in groupby(chunks(), key=lambda c: c[0]):
        yield file, (chunk for _, chunk in group)


class Stream:
    """Lines and stretches of given length from chunks of bytes; holds one record at most."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held, self.at, self.base = chunks, bytearray(), 0, 0

    @property
    def offset(self) -> int:
        return self.base + self.at

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        if self.at:
            del self.held[: self.at]
            self.base, self.at = self.base + self.at, 0
        self.held += chunk
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the file."""
        start = self.at
        while (end := self.held.find(b"\n", start)) < 0:
            searched = len(self.held) - self.at
            if not self.more():
                if self.at == len(self.held):
                    return None
                end = len(self.held)
                break
            start = self.at + searched
        found = bytes(self.held[self.at : end])
        self.at = min(end + 1, len(self.held))
        return found

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left of them."""
        while len(self.held) - self.at < n and self.more():
            pass
        found = bytes(self.held[self.at : self.at + n])
        self.at += len(found)
        return found


def parsed(records: Callable[[int, Stream], Iterator[dict]], schema: pa.Schema, separator: bytes,
           payload: bool) -> Callable:
    """A function for mapInArrow that yields the records of each file in batches of bounded size."""

    def run(batches):
        held, size = [], 0
        for file, chunks in files(batches, separator):
            for record in records(file, Stream(chunks)):
                if not payload:
                    record["payload"] = None
                held.append(record)
                size += len(record["payload"] or b"")
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run
