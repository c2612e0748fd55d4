"""Packing of tokenized documents into fixed windows.

All documents, in the order of the input's partitions, form one stream of token ids that is cut every ``window`` ids. The first
pass tokenizes and notes each document's offset within its partition. Prefix sums over the partition totals then give every
document its place in the stream, and the second pass cuts each document at the window borders that fall inside it; the pieces on
both sides of a border are the boundary records. Only the last window is not full.

A document is read once, tokenized once and never shuffled; what is broadcast, and summed in
one task, is one row of two numbers per partition of the input: some 16 MB for a million partitions.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.common import Cache, Staging, byte_words

_encoders: dict[tuple[str, bool], Cache] = {}

#: Letters of ASCII and Latin-1, then ASCII marks without the apostrophe: two pre-tokens at most, which no normalizer but lower case changes.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable bytes stand for themselves, others for letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}


class WordEncoder:
    """Little-endian ids of a word. White space never is part of a token, so a text's ids are those of its words in a row.

    plain: whether special tokens' strings are ordinary text, or else the special tokens, as is the library's default.

    Simple words of a lower-casing model go to its merges directly, each part once; all others through the whole tokenizer.
    """

    def __init__(self, path: str, plain: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kind, self.model, self.letters = id_kind(self.tokenizer.get_vocab_size()), self.tokenizer.model, byte_letters()
        self.layout = lru_cache(lambda n: struct.Struct(f"<{n}{'H' if self.kind == '<u2' else 'I'}"))
        self.part = Cache(self.part_ids)
        self.simple = all(self.part[a] + self.part[b] == self.whole(f"{c}{b}") for a, b, c in (("école", "),", "École"), ("x", "#$%", "X"), ("straße", "", "Straße")))

    def part_ids(self, part: str) -> bytes:
        spelled = part.encode().decode("latin-1").translate(self.letters)
        return self.bytes_of([t.id for t in self.model.tokenize(spelled)] if part else [])

    def whole(self, word: str) -> bytes:
        return self.bytes_of(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.layout(len(ids)).pack(*ids)

    def __call__(self, word: bytes) -> bytes:
        found = self.simple and _SIMPLE.fullmatch(text := word.decode())
        return self.part[found[1].lower()] + self.part[found[2]] if found else self.whole(word.decode())


def _encoder(path: str, plain: bool = True) -> Cache:
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Cache(WordEncoder(path, plain), 1 << 19)
    return _encoders[path, plain]


def id_kind(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", plain: bool = True) -> DataFrame:
    """part, start (in the part), doc_id, n, ids and width (bytes of an id) of every document; a null text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, plain)
        end, width = np.array([end_id], encode.make.kind).tobytes(), int(encode.make.kind[2])
        part, start = TaskContext.get().partitionId(), 0
        try:
            for batch in batches:
                ids, starts, counts = [], [], []
                for value in batch.column(1):
                    one = b"".join([*map(encode.__getitem__, byte_words(value.as_py())), end])
                    ids.append(one)
                    starts.append(start)
                    counts.append(len(one) // width)
                    start += len(one) // width
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * n, pa.int32())],
                    ["part", "start", "doc_id", "n", "ids", "width"],
                )
        finally:  # the worker's memory is for other steps now
            encode.clear()
            encode.make.part.clear()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "part int, start long, doc_id long, n long, ids binary, width int")


def cut(placed: DataFrame, window: int) -> DataFrame:
    """Pieces of documents that have their place in the stream (column place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, place, n, ids, width in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                values = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(window - offset, n - start)
                    for column, value in zip(out, (doc, start, length, values[start : start + length].tobytes(), n, sequence, offset), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", "place", "n", "ids", "width").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", plain: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts consist of the end id and so get one piece. Repeated rows and null keys are documents of their own. An
    empty input has no pieces. plain: see WordEncoder. Other columns of docs are not read, whatever their names. A very long text
    and its ids are in the memory of a task as a whole.
    """
    staging = Staging(docs.sparkSession, "packing")
    tokens = staging.save(tokenize(docs, tokenizer, end_id, key, text, plain), "tokens", batch_rows=1000)
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("place", F.col("offset") + F.col("start"))  # one row per partition of the input
    return cut(placed, window)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each window; a window has at most its length in pieces, so groups are bounded."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), rows.alias("rows")).select("sequence_id", "n_tokens", F.expr("aggregate(rows, cast('' as binary), (a, r) -> concat(a, r.ids))").alias("ids"))
