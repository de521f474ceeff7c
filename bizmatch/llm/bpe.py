"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts exactly the token sequences that the merges produce. Its states are the tokens last
read, its arcs are labelled with tokens. It starts with one arc from every byte to every byte; merge k, as a
gadget laid on what the gadgets before it left, takes away the arc from the merge's left to its right part
and adds a state for the new token, which copies its incoming arcs from the left part and its outgoing arcs
from the right part as they stand at that time. So an arc u -> v is gone from some time on, or never, and
that time follows from the parts of u and v; as there are too many pairs to list, arcs are worked out when first
asked for and kept in a table. The labels are spelled out in a deterministic automaton over bytes, laid out as
arrays: a state for each beginning of a label, a row of 256 transitions for each state with more behind it (the
others share the row of the state that their end leads to), and the longest label that ends in a state. A row is
16 numbers of blocks of 16 transitions, and rows share the blocks in which they do not differ. A byte
string has exactly one accepting path. It is found from left to right as the last token of each prefix: a byte is
one table step, then the labels that end there are tried from the longest on until one has an arc from the prefix
before it. Many words take their steps together, as rows of the arrays. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkStore
from .common import small_batches, tidied, tidy

NEVER = 1 << 60
#: Splits text before the merges (byte-level BPE).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words and arcs of the lazily filled tables before they start anew; chunks that a worker remembers, and their characters.
TABLE_LIMIT, ARC_LIMIT = 120_000, 1 << 19
CHUNKS, CHUNK_CHARACTERS = 350_000, 7_000_000
#: Characters of texts that are encoded at a time, about.
BLOCK = 1 << 19
#: Longest word that is remembered, in characters; that steps together with others, in bytes. Words that step together.
REMEMBERED, TOGETHER, STEP = 64, 256, 16_384


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class _Arcs(dict):
    """left << 20 | right -> whether that arc of the automaton stays; worked out when first asked for."""

    def __init__(self, lost):
        super().__init__()
        self.lost = lost

    def __missing__(self, key: int) -> bool:
        free = self[key] = self.lost(key >> 20, key & 0xFFFFF) == NEVER
        return free


class _Table:
    """The states by row and byte: a row is 16 numbers of blocks of 16 states, and shares those in which it is like the row that it began as."""

    def __init__(self, rows: int, blocks: int):
        self.block = np.zeros((rows, 16), np.int32)
        self.to = np.zeros((blocks, 16), np.int32)
        self.used = self.own = 1  # blocks; the first one of the row begun last

    def begin(self, row: int, like: int) -> None:
        self.block[row] = self.block[like]
        self.own = self.used

    def __getitem__(self, at):
        row, byte = at
        return self.to[self.block[row, byte >> 4], byte & 15]

    def __setitem__(self, at, state: int) -> None:
        """Of the row begun last."""
        row, byte = at
        block = self.block[row, byte >> 4]
        if block < self.own:
            self.to[self.used] = self.to[block]
            block = self.block[row, byte >> 4] = self.used
            self.used += 1
        self.to[block, byte & 15] = state


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        letters = byte_letters()
        size = max([*vocab.values(), *special.values()]) + 1
        self.label = [b""] * size  # what the arcs of a token emit
        for token, i in vocab.items():
            self.label[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            self.label[i] = token.encode()
        self.special = special
        self.time, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.gone: dict[int, int] = {}  # (left << 20 | right) -> time at which a gadget takes the arc away
        self.arcs = _Arcs(self.lost)
        self.state: dict[bytes, int] = {bytes([b]): vocab[c] for c, b in letters.items() if c in vocab}
        for k, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self._compile()

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        """Merge k: a b -> c. A token that the gadgets before it never leave side by side stays without a state."""
        if self.left[c] >= 0:
            raise ValueError("two merges make the same token")
        made = self.label[a] in self.state and self.label[b] in self.state and self.lost(a, b) == NEVER
        self.gone[a << 20 | b] = k
        self.time[c], self.left[c], self.right[c] = k, a, b
        if made:
            self.state[self.label[c]] = c

    def lost(self, u: int, v: int) -> int:
        """The time at which the arc u -> v goes."""
        tu, tv = self.time[u], self.time[v]
        if tu >= tv and tu >= 0:
            t = self.lost(self.right[u], v)  # copied from u's right part when u was made
            if t < tu:
                return t
        elif tv > tu:
            t = self.lost(u, self.left[v])  # of equal merges the left one comes first
            if t <= tv:
                return t
        return self.gone.get(u << 20 | v, NEVER)

    def _compile(self) -> None:
        """The labels of all states as one deterministic automaton over bytes, in arrays."""
        child, ends = [{}], [-1]
        for word, token in self.state.items():
            at = 0
            for byte in word:
                to = child[at].get(byte)
                if to is None:
                    to = child[at][byte] = len(child)
                    child.append({})
                    ends.append(-1)
                at = to
            ends[at] = token
        self.row = np.zeros(len(child), np.int32)
        self.table = _Table(1 + sum(map(bool, child[1:])), 1 + sum(len({b >> 4 for b in c}) for c in child))  # the state that a byte leads to, by row
        self.token = np.full(len(child), -1, np.int32)  # the longest label that ends in a state
        self.shorter = np.full(len(self.label), -1, np.int32)  # the longest other label that a label ends with
        self.size = np.array([len(x) for x in self.label], np.int32)
        back, order, rows = [0] * len(child), [0], 1  # back: the state of the longest end of a state that is a beginning too
        for node in order:  # shorter beginnings first
            f = back[node]
            if node:
                self.token[node] = ends[node] if ends[node] >= 0 else self.token[f]
                if ends[node] >= 0:
                    self.shorter[ends[node]] = self.token[f]
                self.row[node] = self.row[f]
            if node and child[node]:
                self.table.begin(rows, self.row[f])
                self.row[node], rows = rows, rows + 1
            for byte, to in child[node].items():
                back[to] = int(self.table[self.row[f], byte]) if node else 0
                self.table[self.row[node], byte] = to
                order.append(to)
        self.views = [memoryview(x) for x in (self.table.to.reshape(-1), self.table.block.reshape(-1), self.row, self.token, self.shorter, self.size)]

    def encode(self, word: bytes) -> list[int]:
        """The labels of word's one path."""
        if word in self.state:
            return [self.state[word]]
        to, block, row, token, shorter, size = self.views
        arcs, last, at = self.arcs, [0], 0
        if len(arcs) >= ARC_LIMIT:
            arcs.clear()
        for i, byte in enumerate(word, 1):
            at = to[block[row[at] << 4 | byte >> 4] << 4 | byte & 15]
            t = token[at]
            while t >= 0 and size[t] < i and not arcs[last[i - size[t]] << 20 | t]:  # only one can be last
                t = shorter[t]
            if t < 0:
                raise ValueError("a byte has no token")
            last.append(t)
        out, n = [], len(word)
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """The labels of each word's path; the words step through the tables together."""
        out = [[self.state[w]] if w in self.state else None if w and len(w) <= TOGETHER else self.encode(w) for w in words]
        rest = sorted((k for k, ids in enumerate(out) if ids is None), key=lambda k: -len(words[k]))
        for lo in range(0, len(rest), STEP):
            part = rest[lo : lo + STEP]
            for k, ids in zip(part, self._together([words[k] for k in part])):
                out[k] = ids
        return out

    def _together(self, words: list[bytes]) -> list[list[int]]:
        """The same for words that are not empty, the longest first."""
        if len(self.arcs) >= ARC_LIMIT:
            self.arcs.clear()
        arc, size = self.arcs.__getitem__, self.size
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        text = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(text), np.int32)  # by a prefix's last byte
        at = np.zeros(len(words), np.int32)
        going = np.searchsorted(-length, -np.arange(length[0]), "left")  # words with more bytes than that
        for i, n in enumerate(going):
            here = start[:n] + i
            at = self.table[self.row[at[:n]], text[here]]
            t, open_ = self.token[at], None
            while len(here):
                if t.min() < 0:
                    raise ValueError("a byte has no token")
                before = here - size[t]
                inner = np.flatnonzero(before >= (start[:n] if open_ is None else start[open_]))
                last[here] = t  # of those that are lost, a shorter one takes the place
                keys = (last[before[inner]].astype(np.int64) << 20) | t[inner]
                lost = inner[~np.fromiter(map(arc, keys.tolist()), bool, len(keys))]
                open_ = lost if open_ is None else open_[lost]
                here, t = here[lost], self.shorter[t[lost]]
        on = np.zeros(len(text), bool)
        here, first = start + length - 1, start
        while len(here):
            on[here] = True
            here = here - size[last[here]]
            more = here >= first
            here, first = here[more], first[more]
        ends = np.cumsum(on)[start + length - 1].tolist()
        ids = last[on].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class ByteBpe:
    """Encodes and decodes texts as the vocabulary file at `path` says (byte-level BPE, special tokens split off first)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.automaton = Automaton(model["vocab"], model["merges"], special)
        self.special = special
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words: dict[str, list[int]] = {}
        label = self.automaton.label
        self.label_start = np.concatenate(([0], np.cumsum([len(x) for x in label]))).astype(np.int64)
        self.label_bytes = np.frombuffer(b"".join(label), np.uint8)
        # a chunk is a space and what follows up to the next one; no token spans the start of one after a non-space
        self.chunks = ChunkStore(self.encode_chunks, flagged=lambda c: not c or c[0].isspace() or c[-1].isspace(), limit=CHUNKS, limit_chars=CHUNK_CHARACTERS)

    def word(self, w: str, keep: bool = True) -> list[int]:
        ids = self.words.get(w)
        if ids is None:
            ids = self.automaton.encode(w.encode())
            if keep and len(w) <= REMEMBERED:
                if len(self.words) >= TABLE_LIMIT:
                    self.words.clear()
                self.words[w] = ids
        return ids

    def encode(self, text: str, keep: bool = True) -> list[int]:
        out: list[int] = []
        for part in self.split.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for w in SPLIT.findall(part):
                out.extend(self.word(w, keep))
        return out

    def split_chunk(self, c: str) -> list[str]:
        """The words of a space and c; letters alone, or with one mark behind them, are split without the pattern."""
        if c.isalpha():
            return [" " + c]
        if c[-1:] in (",", ".") and c[:-1].isalpha():
            return [" " + c[:-1], c[-1]]
        return SPLIT.findall(" " + c)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """The ids of a space and each of the chunks; words that are new are encoded together."""
        if len(self.words) >= TABLE_LIMIT:
            self.words.clear()
        plain = [not any(s in c for s in self.special) for c in chunks]
        split = [self.split_chunk(c) if p else [] for c, p in zip(chunks, plain)]
        known = self.words
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in known))
        new = dict(zip(fresh, self.automaton.encode_all([w.encode() for w in fresh])))
        out = []
        for c, p, words in zip(chunks, plain, split):
            if not p:
                out.append(self.encode(" " + c, keep=False))
            elif len(words) == 1:
                out.append(new.get(words[0]) or known[words[0]])
            else:
                out.append([i for w in words for i in new.get(w) or known[w]])
        known.update((w, ids) for w, ids in new.items() if len(w) <= REMEMBERED)
        return out

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's count."""
        heads, rests = [], []
        for t in texts:
            head, *rest = t.split(" ")
            heads.append(head)
            rests.append(rest)
        found, odd = self.chunks.look_up(rests)
        pieces, counts = [], np.zeros(len(texts), np.int64)
        for k, (head, ids) in enumerate(zip(heads, found)):
            if odd[k] or (rests[k] and (not head or head[-1].isspace())):
                ids = np.array(self.encode(texts[k]), np.uint32)
            elif head:
                first = np.array(self.encode(head), np.uint32)
                ids = np.concatenate((first, ids)) if len(ids) else first
            pieces.append(ids)
            counts[k] = len(ids)
        return np.concatenate(pieces) if pieces else np.empty(0, np.uint32), counts

    def forget(self) -> None:
        """Empty the tables that texts have filled; the automaton stays."""
        self.words, self.automaton.arcs = {}, _Arcs(self.automaton.lost)
        self.chunks.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the arcs' labels emit."""
        start = self.label_start[ids]
        size = self.label_start[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        return self.label_bytes[at].tobytes()


@functools.lru_cache(maxsize=2)
def _load(path: str) -> ByteBpe:
    bpe = ByteBpe(path)
    tidy()
    return bpe


def _blocks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together."""
    at = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > most:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def bpe_round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text with the byte-level BPE in the file `tokenizer`, and decode the ids again.

    Returns (doc_id, n_tokens long, ids binary, decoded string): ids are little-endian unsigned 32-bit integers.
    A null text counts as empty, an empty text gives no ids; null and repeated doc_ids pass as they are; an empty
    table gives no rows; other columns are not read. Rows stay where they are (no exchange); what a task holds is one block of texts and
    tables of bounded size.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(tokenizer)
        try:
            for batch in batches:
                ids, column = batch.column(0), batch.column(1)
                for lo, hi in _blocks(pc.utf8_length(column).fill_null(0).to_pylist(), BLOCK):
                    flat, counts = bpe.encode_many([t or "" for t in column[lo:hi].to_pylist()])
                    ends = np.cumsum(counts)
                    each = [flat[e - c : e] for e, c in zip(ends, counts)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids[lo:hi].cast(pa.int64()), pa.array(counts), pa.array([x.astype("<u4", copy=False).tobytes() for x in each], pa.binary()),
                            pa.array([bpe.decode(x).decode("utf-8", "replace") for x in each], pa.string()),
                        ],
                        schema=schema,
                    )
        finally:
            bpe.forget()  # the worker is kept, and other stages need the memory

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids binary, decoded string")
