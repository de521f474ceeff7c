"""BPE automaton, token records."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bizmatch.llm.binary import ChunkedTokenizer, from_payload, read_record, read_records, records_dir, to_payload, write_records
from bizmatch.llm.bpe import ByteBpe, bpe_round_trip
from bizmatch.llm.chunks import ChunkStore

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "a\n b\n\nc", "don't I'LL 've", "aaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>x <|endoftext|>", "é漢字 😀​\x1c\x85 x", "́a", "1234567890 12", "İSTANBUL ΑΣ", "x" * 3000, " \t\r\n ", "…—"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(BYTES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def check(bpe, library, texts):
    flat, counts = bpe.encode_many(texts)
    at = 0
    for text, n, want in zip(texts, counts, library.encode_batch(texts, add_special_tokens=False)):
        ids = flat[at : at + n]
        at += n
        assert ids.tolist() == want.ids, repr(text)
        assert bpe.decode(ids).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_odd_texts(bpe, library):
    check(bpe, library, ODD)


def test_random_words(bpe, library):
    random.seed(1)
    for letters in ("ab", "etaoin shrdlu", "the ing,. '\n", "0123456789 "):
        check(bpe, library, ["".join(random.choice(letters) for _ in range(random.randrange(80))) for _ in range(400)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(bpe, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    check(bpe, library, texts)


def test_tables_start_anew(library, monkeypatch):
    from bizmatch.llm import bpe as module

    monkeypatch.setattr(module, "TABLE_LIMIT", 5)
    monkeypatch.setattr(module, "ARC_LIMIT", 5)
    small = ByteBpe(BYTES)
    small.chunks.limit = 3
    for _ in range(3):
        check(small, library, ["one two three four", "five six seven"])


@pytest.mark.parametrize("step, together", [(16_384, 256), (3, 5), (1, 0)])
def test_words_that_step_together(bpe, library, monkeypatch, step, together):
    from bizmatch.llm import bpe as module

    monkeypatch.setattr(module, "STEP", step)
    monkeypatch.setattr(module, "TOGETHER", together)
    random.seed(2)
    words = ["".join(random.choice("aeinrst hé漢") for _ in range(n)).strip() for n in [*range(1, 40)] * 5 + [300, 2000]]
    words = [w for w in words if w] + ["a" * 255, "a" * 256, "a" * 257]
    got = bpe.automaton.encode_all([w.encode() for w in words] + [b""])
    assert got[-1] == [] and got[:-1] == [bpe.automaton.encode(w.encode()) for w in words]
    plain = [(w, ids) for w, ids in zip(words, got) if w.isalpha()]
    assert len(plain) > 20 and [ids for _, ids in plain] == [x.ids for x in library.encode_batch([w for w, _ in plain], add_special_tokens=False)]


def test_tables_follow_the_labels(bpe):
    """A state's longest label and the shorter ones behind it are just the labels that end there."""
    a = bpe.automaton
    for word in (b" international", "über".encode(), b"<<<>>> 12"):
        at = 0
        for i, byte in enumerate(word, 1):
            at = int(a.table[a.row[at], byte])
            t, found = int(a.token[at]), []
            while t >= 0:
                found.append(a.label[t])
                t = int(a.shorter[t])
            assert found == [word[j:i] for j in range(i) if word[j:i] in a.state]


def test_transitions_are_small(bpe):
    """Rows share what they do not differ in: laid out one by one they take 64 MB in each worker."""
    a = bpe.automaton
    assert sum(x.nbytes for x in a.views) < 16 << 20


def test_workers_keep_no_tables_of_texts(spark):
    docs = spark.createDataFrame([(k, f"some words{k} of text{k}") for k in range(50)], "doc_id long, text string").coalesce(1)
    assert bpe_round_trip(docs, BYTES).where("n_tokens > 0").count() == 50

    def kept(batches):
        import pyarrow as pa

        from bizmatch.llm.bpe import _load

        for _ in batches:
            pass
        loaded, known = _load.cache_info().currsize, _load(BYTES)
        yield pa.RecordBatch.from_pydict({"loaded": [loaded], "n": [len(known.words) + len(known.automaton.arcs) + len(known.chunks.numbers)]})

    assert [tuple(r) for r in spark.range(1).coalesce(1).mapInArrow(kept, "loaded long, n long").collect()] == [(1, 0)]


def test_chunk_store():
    store = ChunkStore(lambda many: [[len(c)] * len(c) for c in many], flagged=lambda c: c == "z", limit=2)
    for _ in range(2):
        found, odd = store.look_up([["aa", "b"], [], ["z", "aa"]])
        assert [f.tolist() for f in found] == [[2, 2, 1], [], [1, 2, 2]] and odd.tolist() == [False, False, True]


def test_round_trip_query(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(90, None, "x"), (None, "null id", "x"), (3, "again", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe_round_trip(df, BYTES).withColumn("h", F.sha2("ids", 256)).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), t or "") for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["h"], r["decoded"]) for r in got) == want
    assert bpe_round_trip(df.limit(0), BYTES).count() == 0


def wanted(rows):
    library, out, start = Tokenizer.from_file(WORDS), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_records(spark):
    rows = [(7 * k % 101, t) for k, t in enumerate(ODD)] + [(500, None), (501, "word " * 30000), (None, "no id")]
    uri = records_dir(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("payload", F.lit(1)).withColumn("bucket", F.lit("x"))
    manifest = write_records(df, uri, WORDS)
    got = read_records(manifest, uri).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got), key=key) == sorted(wanted(rows), key=key)
    first = manifest.orderBy("shard").first()
    assert read_record(uri, first["shard"], 0)[0] is None
    store, path = fs.FileSystem.from_uri(uri)
    name = f"{path}/shard-{first['shard']:05d}.rec"
    data = bytearray(store.open_input_stream(name).read())
    data[20] ^= 1
    with store.open_output_stream(name) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        read_records(manifest, uri).collect()
    empty = records_dir(spark)
    assert read_records(write_records(df.limit(0), empty, WORDS), empty).count() == 0


def test_special_tokens_in_other_letters():
    texts = [f"{a}{t}{b}" for t in ("<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "<|STARTOFTEXT|>", "<|endoftext|>") for a, b in (("", ""), ("Some Words ", " AND More"), ("X", "Y"), ("É ", " é"))]
    texts += [" ".join(texts), "Plain Words Only"]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ChunkedTokenizer(WORDS).encode_many(texts)] == want


def test_payloads():
    for ids in ([], [1], [70000, 2], list(range(5000)), [65535] * 100):
        for doc in (None, -5, 1 << 60):
            got = from_payload(to_payload(doc, np.array(ids, np.uint32)))
            assert got[0] == doc and got[1].tolist() == ids
    assert struct.calcsize("<BqI") == 13
