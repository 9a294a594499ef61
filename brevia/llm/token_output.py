"""Token-id output: Parquet list columns, written in document order and read back selectively.

Encoding is done by the tokenizers library. Its byte-level pre-tokenizer cuts a text into pieces that
are encoded independently of each other, so each task cuts its texts itself (vectorised over code
points, by the same rules), has the library encode every distinct piece once, as pre-tokenized
input, and puts the documents' ids together by gathers. Pieces stay known in a bounded table.

Files: rows are range-partitioned and sorted by key, so file order is key order. ids is a list column
with dictionary pages, of which most hold few distinct ids; the key and n_tokens are delta-encoded
(format version 2). Row groups and pages are kept small and carry page indexes: a range of keys reads
only its pages, and n_tokens is read without the ids. Every document ends with id END.

Null is the empty text, which is END alone. Rows with equal keys are in order of their texts, rows
without a key come first. Extra columns are left out. An empty table writes and reads an empty file.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brevia.llm.pieces import KnownPieces, span_keys
from brevia.llm.shared import cut, map_arrow, table_path, tables
from brevia.llm.textkit import HEAD, chunks, text_bytes

END = 0
CHUNK = 1 << 20
MOST_PIECES = 1 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000

OTHER, LETTER, NUMBER, BLANK, UNKNOWN = range(5)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes with document offsets: the string, its code points and the offsets in code points."""
    text = data.tobytes().decode()
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(HEAD[data], out=heads[1:])
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), heads[offsets]


def piece_starts(points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer cuts: its pieces are the apostrophe endings 's 't 're 've 'm 'll 'd,
    runs of letters, of numbers and of other signs, each with one space before it if there is one, and
    blanks, of which a run before other text leaves its last one apart."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    opens = np.zeros(n, bool)
    opens[offsets[:-1][offsets[:-1] < n]] = True
    before = np.roll(kind, 1)
    change = (kind != before) | opens
    closes = np.roll(opens, -1)
    closes[-1] = True
    blank = kind == BLANK
    after_space = np.roll(points, 1) == 0x20
    after_space &= ~opens
    follows = np.roll(~blank, -1) & ~closes  # the next code point, of this document, is no blank
    start = np.where(blank, change | follows, change & ~after_space)
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[~closes[quote]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = points[quote + 1]
        two = np.where(closes[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of string columns. added: the strings of added tokens in a text are those tokens, as is the library's
    default; else they are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if added and names else None
        vocabulary = self.tokenizer.get_vocab()
        self.spans = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes that a token stands for: one for each sign of its name
        for name, k in vocabulary.items():
            self.spans[k] = len(name)
        for k, token in self.tokenizer.get_added_tokens_decoder().items():
            self.spans[k] = len(token.content.encode())
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.known = KnownPieces(MOST_PIECES)

    def kind(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point; the library is asked once about each, as its Unicode version decides."""
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kind == UNKNOWN]).tolist():
                self.kinds[p] = next((k for k, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(sign + chr(p))) == 1), BLANK)
            kind = self.kinds[points]
        return kind

    def learn(self, pieces: list[str], keys: np.ndarray) -> None:
        found, sizes = [], []
        for k in range(0, len(pieces), 5000):
            part = pieces[k : k + 5000]
            (coded,) = self.tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, np.int32)
            # the fast call doesn't say which piece an id is of; the bytes that the ids stand for do
            ends, at = np.cumsum([len(x.encode()) for x in part]), np.cumsum(self.spans[ids])
            last = np.searchsorted(at, ends, "right")
            if not len(ids) or at[-1] != ends[-1] or (at[last - 1] != ends).any():
                coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids, last = np.array(coded.ids, np.int32), np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)))
            found.append(ids)
            sizes.append(np.diff(last, prepend=0))
        self.known.learn(keys, np.concatenate(found), np.concatenate(sizes))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each followed by END, and n + 1 offsets."""
        text, points, at = code_points(data, offsets)
        spans = [x.span() for x in self.added.finditer(text)] if self.added else []
        spans = np.array([x for x in spans if np.searchsorted(at, x[0], "right") == np.searchsorted(at, x[1] - 1, "right")], np.int64).reshape(-1, 2)
        starts = piece_starts(points, self.kind(points), np.unique(np.append(at, spans)) if len(spans) else at)
        if len(spans):  # each is one piece
            k = np.searchsorted(spans[:, 0], starts, "right") - 1
            starts = starts[(k < 0) | (starts == spans[k, 0]) | (starts >= spans[k, 1])]
        ends = np.append(starts[1:], len(points))
        distinct, one, which = np.unique(span_keys(points, starts, ends), return_index=True, return_inverse=True)
        new = self.known.missing(distinct)
        if new.any():
            self.learn([text[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)], distinct[new])
        return self.known.ids(distinct, which, np.searchsorted(starts, at), END)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """One for each tokenizer file and worker process: its known pieces last from task to task."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids) of every row, in order of key within and between partitions."""

    def run(batches):
        model = encoder(path, added=True)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for k, end, part, at in chunks(data, offsets, CHUNK):
                ids, ids_at = model.encode(part, at)
                column = pa.ListArray.from_arrays(pa.array(ids_at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, end - k), pa.array(np.diff(ids_at).astype(np.int64)), column], [key, "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return texts.repartitionByRange(key).sortWithinPartitions(key, "text").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>")


def write_ids(encoded: DataFrame, to: str, key: str = "doc_id") -> None:
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option(f"parquet.enable.dictionary#{key}", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(to)
    )


def read_ids(spark: SparkSession, path: str, first=None, last=None, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) of the keys from first to last: a filter that page indexes answer."""
    found = spark.read.parquet(path)
    if first is not None:
        found = found.filter(F.col(key) >= first)
    return found if last is None else found.filter(F.col(key) <= last)


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before: the totals of the files before, of which there are as
    many as partitions were written, and a running sum inside each file.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<i4", copy=False)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)], [key, "n_tokens", "ids_crc32", "file", "row"])

        return step

    stored = spark.read.parquet(path)
    kind = stored.schema[key].dataType.simpleString()
    rows = stored.select(key, "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    read = cut(map_arrow(rows, f"`{key}` {kind}, n_tokens long, ids_crc32 long, file string, row long", make))
    totals = sorted(read.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # part-00000-..., part-00001-...
    before, sizes = [], 0
    for name, n in totals:
        before.append((name, sizes))
        sizes += n
    starts = F.broadcast(spark.createDataFrame(before, "file string, before long"))  # a row for each file
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, "file")
    return placed.select(key, (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_output(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    to = table_path(spark, "token-ids")
    write_ids(encode_documents(tables(spark, sf_dir, "documents"), path), to)
    return digest(spark, to)
