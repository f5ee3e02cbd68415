"""Token counts: pieces are counted once per distinct pre-token and joined to pre-token frequencies.

Documents are taken in blocks.  A block's pre-tokens are dealt by hash over buckets, and for each block and
bucket there is one packed row with the pre-tokens, the places of the documents that hold them and their
frequencies there.  All rows of a bucket meet in one task: it tokenizes each distinct pre-token of the bucket
once, joins the numbers of pieces to the frequencies, and sends a block the sums of its documents.  A pre-token has one
bucket, so it is counted once in all, and a frequent one costs its bucket one entry a block.  No ids are kept.

Null texts count as empty.  Empty texts have 0 bytes and 0 tokens.  Very long texts are whole in a block
of their own.  Repeated rows are counted each for itself.  An empty table gives no rows.  Other columns are
ignored.  A block is rows that follow each other, so docs should be files or a checkpoint: rows that
come in another order when a lost task is run again would not fit the sums that other tasks have read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import small_batches

#: The published pre-token pattern of byte-level BPE, with \p{L} and \p{N} written
#: as classes that the re module has; they are the same for the characters of PLAIN.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""

#: Characters that every Unicode release since 2010 and both libraries put into the same class.
#: Texts with others are split by the tokenizer's own pre-tokenizer.
PLAIN = "\u0000-\u001b -±´-¸º»¿-ԧա-ֆא-תء-ؿف-يऄ-ह‐-‧‰-⁞₠-₸←-⇿ぁ-ゖァ-ヺ一-龥가-힣"

#: A block ends at so many documents or characters.
BLOCK_ROWS, BLOCK_CHARS = 1_000, 4_000_000

#: UTF-8 bytes of text for each bucket, on average.
BUCKET_BYTES = 16 << 20


class Splitter:
    """Splits texts into pre-tokens and counts the pieces of pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = re.compile(BYTE_LEVEL_PATTERN).findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.special = [t.content for _, t in sorted(self.tokenizer.get_added_tokens_decoder().items())]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies, and the number of special strings, which are one token each."""
        parts, special = [text], 0
        for s in self.special:
            if s in text:
                cut = [p.split(s) for p in parts]
                special += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
        found: Counter = Counter()
        for p in parts:
            if self.odd(p):
                found.update([p[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(p)])
            else:
                found.update(self.split(p))
        return found, special

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


#: One splitter for each tokenizer file in a worker, which serves many tasks.
_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def packed(found: list[Counter], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed frequencies) for each bucket that the documents' pre-tokens fall into.

    Packed: the numbers of pre-tokens and of entries, the pre-tokens' UTF-8 lengths and numbers of documents, and the
    places and frequencies (32 bits each but for places, 16 bits), then the pre-tokens; pre-token by pre-token, compressed.
    """
    sizes = [len(f) for f in found]
    if not any(sizes):
        return
    coded = pa.array([w for f in found for w in f], pa.large_string()).dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy()
    bucket = np.array([bucket_of(w, buckets) for w in words.cast(pa.large_binary()).to_pylist()], np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Entries in the order of their pre-tokens' ranks.
    entries = np.argsort(rank[index], kind="stable")
    places = np.repeat(np.arange(len(found), dtype=np.uint16), sizes)[entries]
    counts = np.fromiter((n for f in found for n in f.values()), np.uint32, len(index))[entries]
    widths = np.bincount(rank[index], minlength=len(order)).astype(np.uint32)
    words = words.take(pa.array(order))
    offsets, raw = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1), words.buffers()[2]
    ends, held = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)]), bucket[order]
    starts = np.flatnonzero(np.diff(held, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(held)]):
        x, y = ends[a], ends[b]
        parts = [np.array([b - a, y - x], np.uint32), np.diff(offsets[a : b + 1]).astype(np.uint32), widths[a:b], counts[x:y], places[x:y]]
        yield int(held[a]), zlib.compress(b"".join([*(p.tobytes() for p in parts), raw[offsets[a] : offsets[b]].to_pybytes()]), 1)


def unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, numbers of documents, places, frequencies."""
    data = zlib.decompress(data)
    words, entries = np.frombuffer(data, np.uint32, 2).tolist()
    lengths, widths = np.frombuffer(data, np.uint32, words, 8), np.frombuffer(data, np.uint32, words, 8 + 4 * words)
    counts = np.frombuffer(data, np.uint32, entries, 8 + 8 * words)
    at = 8 + 8 * words + 4 * entries
    places = np.frombuffer(data, np.uint16, entries, at)
    ends = (at + 2 * entries + np.cumsum(lengths, dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([at + 2 * entries, *ends], ends)], widths, places, counts


def blocks(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """docs: (doc_id, text).  A row (bucket, block, data) for each block and bucket, and for each block one with its ids, bytes and special strings."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = chars = 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()):
            if i > start and (chars + n > BLOCK_CHARS or i - start == BLOCK_ROWS):
                yield b.slice(start, i - start)
                start, chars = i, 0
            chars += n
        if start < b.num_rows:
            yield b.slice(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task = splitter(path).frequencies, TaskContext.get().partitionId()
        for k, b in enumerate(part for whole in batches for part in cut(whole)):
            block = task << 32 | k
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = [split(t) for t in texts]
            rows = list(packed([f for f, _ in found], buckets))
            ids, sizes, special = b.column("doc_id").to_pylist(), [len(t.encode()) for t in texts], [n for _, n in found]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(r[0] for r in rows), bucket_of(b"%d" % block, buckets)], pa.int32()),
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([*(r[1] for r in rows), None], pa.binary()),
                    pa.array([None] * n + [ids], pa.list_(b.schema.field("doc_id").type)),
                    pa.array([None] * n + [sizes], pa.list_(pa.int64())),
                    pa.array([None] * n + [special], pa.list_(pa.int64())),
                ],
                ["bucket", "block", "data", "ids", "sizes", "special"],
            )

    return docs.mapInArrow(run, f"bucket int, block bigint, data binary, ids array<{kind}>, sizes array<bigint>, special array<bigint>")


def joined(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the packed frequencies by the block's sums of frequency times pieces: places (16 bits each), then sums (64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = splitter(path).pieces
        known: dict[bytes, int] = {}  # the pieces of this task's pre-tokens, each counted once

        def summed(data: bytes) -> bytes:
            words, widths, places, counts = unpacked(data)
            new = [w for w in words if w not in known]
            known.update(zip(new, count([w.decode() for w in new])))
            n = np.zeros(int(places.max()) + 1, np.int64)
            np.add.at(n, places, counts * np.repeat(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), widths))
            held = np.flatnonzero(n)
            return held.astype(np.uint16).tobytes() + n[held].tobytes()

        for b in batches:
            data = pa.array([None if d is None else summed(d) for d in b.column("data").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("block"), data, *(b.column(c) for c in ("ids", "sizes", "special"))], ["block", "data", "ids", "sizes", "special"])

    return run


def sums(limit: int) -> Callable[[pa.Table], pa.Table]:
    """From all rows of a block the counts of its documents."""

    def run(t: pa.Table) -> pa.Table:
        one = t.filter(pc.is_null(t["data"]))
        ids, sizes, special = (one[c].combine_chunks().flatten() for c in ("ids", "sizes", "special"))
        n = special.to_numpy().copy()
        for d in t["data"].drop_null().to_pylist():
            held = len(d) // 10
            n[np.frombuffer(d, np.uint16, held)] += np.frombuffer(d[2 * held :], np.int64)
        return pa.table([ids, sizes, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    The tokenizer's file must exist at tokenizer_path on every executor; truncation and padding are off.
    There are so many buckets that one has at most BUCKET_BYTES of text on average, and as many as the session shuffles into at least.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    size = slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows = blocks(slim, tokenizer_path, buckets).repartitionById(buckets, "bucket")
    counted = rows.mapInArrow(joined(tokenizer_path), f"block bigint, data binary, ids array<{kind}>, sizes array<bigint>, special array<bigint>")
    return counted.groupBy("block").applyInArrow(sums(limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
