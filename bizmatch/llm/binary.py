"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard's data file holds one record after the other: the payload's length (8 bytes), that length's masked
checksum (4), the payload, its masked checksum (4). Its index file holds the offset of each record (8 bytes
each), so that any record can be read alone and in any order. A payload is a flag byte, the document's id
(8 bytes), the count of ids (4), and the ids, in 2 or 4 bytes each and compressed where that is shorter. All
numbers are little-endian.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .chunks import ChunkStore
from .common import dealt, materialize, scratch_dir, width

#: Added to a rotated checksum, so that checksums of data that holds checksums stay sound (fixed value of the record format).
MASK = 0xA282EAD8
#: The most shards of one write; beyond this they grow instead, as rows are streamed.
MOST_SHARDS = 10_000
WIDE, PACKED, NO_ID = 1, 2, 4
#: Pieces between spaces that a worker remembers.
CHUNKS = 1_600_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def to_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    packed = zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 64 else raw
    small = len(packed) < len(raw)
    flags = WIDE * wide | PACKED * small | NO_ID * (doc_id is None)
    return struct.pack("<BqI", flags, doc_id or 0, len(ids)) + (packed if small else raw)


def from_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = struct.unpack_from("<BqI", payload)
    kind = "<u4" if flags & WIDE else "<u2"
    raw = payload[13:]
    if flags & PACKED:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=n * (4 if flags & WIDE else 2))
    ids = np.frombuffer(raw, kind)
    if len(ids) != n:
        raise ValueError("a record's ids are cut short")
    return None if flags & NO_ID else doc_id, ids.astype("<u4")


def _read_one(file) -> bytes | None:
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    rest = file.read(n + 4)
    if len(rest) < n + 4 or struct.unpack("<I", rest[n:])[0] != masked_crc(rest[:n]):
        raise ValueError("a record is damaged")
    return rest[:n]


def read_record(uri: str, shard: int, record: int) -> tuple[int | None, np.ndarray]:
    """The id and token ids of one record, by the shard's index: what a shuffled read does."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(f"{path}/shard-{shard:05d}.idx") as f:
        offset = struct.unpack("<Q", f.read_at(8, record * 8))[0]
    with store.open_input_file(f"{path}/shard-{shard:05d}.rec") as f:
        f.seek(offset)
        return from_payload(_read_one(f))


#: How the vocabulary treats text before its merges, where words of letters can go to the merges at once.
PLAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class ChunkedTokenizer:
    """The tokenizers library, called once for each distinct piece between spaces.

    For vocabularies that drop white space before splitting, so that a space never lies within a token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        self.folded = [s.lower() for s in self.special]
        self.mark = max(special) if special else None
        self.store = ChunkStore(self._encode, limit=CHUNKS, limit_chars=20 * CHUNKS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = (spec["normalizer"], spec["pre_tokenizer"]) == PLAIN
        self.letters = {b: c for c, b in byte_letters().items()}
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ",."}

    def _word(self, c: str) -> list[int] | None:
        """The ids of a word of letters below U+0100, with or without a comma or stop behind it; None for anything else.

        Such letters are normalised one by one, and are one piece: the library's merges take it as it is.
        """
        tail = self.ends.get(c[-1:])
        word = c if tail is None else c[:-1]
        if not word.isalpha():
            return None
        if word.isascii():
            word = word.lower()
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return None
            word = "".join(map(self.letters.__getitem__, word.lower().encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        return ids if tail is None else ids + tail

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        out: list = list(map(self._word, chunks)) if self.plain else [None] * len(chunks)
        out = [None if x is None else np.array(x, np.uint32) for x in out]
        plain = [k for k, c in enumerate(chunks) if out[k] is None and self.mark is not None and not any(s in c for s in self.special)]
        mark = self.special[-1] if self.special else ""
        groups = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        # a special token between two pieces keeps them apart, and its id shows where each ends
        found = self.tokenizer.encode_batch_fast([mark.join(chunks[k] for k in g) for g in groups], add_special_tokens=False)
        mark_id = self.tokenizer.token_to_id(mark) if mark else -1
        for g, e in zip(groups, found):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == mark_id)
            lo = np.concatenate(([0], cuts + 1))
            hi = np.concatenate((cuts, [len(ids)]))
            for k, a, b in zip(g, lo.tolist(), hi.tolist()):
                out[k] = ids[a:b]
        for k, c in enumerate(chunks):
            if out[k] is None:
                out[k] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32)
        return out

    def _lower(self, text: str) -> str:
        """text in lower case where that is the vocabulary's own (letters below U+0100): fewer pieces are distinct then."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        # a special token is one only as it is written: in other letters it must not become one
        return text if any(s in low for s in self.folded) else low

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if self.plain:
            texts = list(map(self._lower, texts))
        return self.store.look_up([t.split(" ") for t in texts])[0]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkedTokenizer:
    return ChunkedTokenizer(path)


def encode_payloads(docs: DataFrame, tokenizer: str, bounds: list[int], end_id: int | None) -> DataFrame:
    """(bucket, doc_id, n_tokens, payload) of every document; bucket is the range between bounds that its id falls in."""
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    edges = np.array(bounds, np.int64)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size < 2 << 20):
                    size += len(texts[to] or "")
                    to += 1
                found = [np.concatenate((x, tail)) for x in encoder.encode_many([t or "" for t in texts[at:to]])]
                # nulls sort first
                bucket = [0 if i is None else int(np.searchsorted(edges, i, side="left")) for i in ids[at:to]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array(ids[at:to], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([to_payload(i, x) for i, x in zip(ids[at:to], found)], pa.binary())],
                    schema=schema,
                )
                at = to

    return docs.mapInArrow(run, "bucket int, doc_id long, n_tokens long, payload binary")


def write_records(docs: DataFrame, uri: str, tokenizer: str, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write the ids under `uri`, in ascending doc_id order over shards and within them.

    Returns the manifest (shard, n_docs, n_tokens, bytes), one row for each shard that has documents. A null text
    counts as empty (the end id alone); null ids come first; rows with one id follow each other in the order of
    their payloads; an empty table writes nothing; other columns are not read. The texts stay in their task: only payloads are dealt, by ranges of doc_id whose
    bounds come from a scan of that column. Files appear under their name only when complete, and a task that runs
    again writes the same bytes.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = min(MOST_SHARDS, width(docs))
    cuts = docs.select(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100_000).alias("c")).first()["c"] if shards > 1 else None
    bounds = sorted(set(cuts or []))
    rows = dealt(encode_payloads(docs, tokenizer, bounds, end_id), len(bounds) + 1).sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "payload")
    schema = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        mine = uuid.uuid4().hex
        shard, out, offsets, tokens, at = None, None, [], 0, 0

        def close():
            out.close()
            with store.open_output_stream(f"{path}/.{mine}.idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            for kind in ("idx", "rec"):
                store.move(f"{path}/.{mine}.{kind}", f"{path}/shard-{shard:05d}.{kind}")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, len(offsets), tokens, at), schema.types)], schema=schema)

        for batch in batches:
            for b, n, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b != shard:
                    if out:
                        yield close()
                    shard, out, offsets, tokens, at = b, store.open_output_stream(f"{path}/.{mine}.rec", buffer_size=1 << 20), [], 0, 0
                record = frame(payload.as_py())
                out.write(record)
                offsets.append(at)
                at += len(record)
                tokens += n
        if out:
            yield close()

    return materialize(rows.mapInArrow(write, "shard int, n_docs long, n_tokens long, bytes long"), "manifest")


def read_records(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every record of a write, each file read by one task.

    start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers. A damaged
    length or record is an error.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"), "n_docs")
    n = int(manifest.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]) + 1
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard, start, n_docs in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{path}/shard-{shard:05d}.rec", buffer_size=1 << 20) as f:
                    found, size = [], 0
                    while (payload := _read_one(f)) is not None:
                        doc, ids = from_payload(payload)
                        found.append((doc, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        n_docs -= 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)
                    if n_docs:
                        raise ValueError(f"shard {shard} holds another number of records than the manifest")

    return dealt(files, n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def records_dir(spark: SparkSession) -> str:
    """A new folder for records under the cluster's shared folder."""
    base = scratch_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/records-{uuid.uuid4().hex}"
