"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text.

A text is cut into windows of several words. Each window is compressed under two dictionaries, and its evidence is
the length under the ordinary one less that under the toxic one, from a threshold on. Both hold the same usual
words at the same distances, so that ordinary text costs the same under both and the difference is what the toxic
one's own pieces save. A text's score is its windows' evidence over a power of their number, calibrated.

A dictionary's content is trained: pieces of words (beginnings, ends, whole words) ranked by how much more often
toxic texts hold them, each of them having nothing in common with those before it; so a stem is found in words that
no labelled text held. (The library's own trainer ranks by frequency alone, which buries a toxic text's few telling
pieces among the usual ones.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidied, tidy
from .fitting import isotonic, labelled_sample, remainder

#: Labelled rows that are learned from, about; folds of the calibration.
FIT_ROWS, FOLDS = 12_000, 5
#: Of these the best is taken: pieces of the toxic dictionary, least evidence of a window, power of the windows' number.
PIECES, LEAST, POWERS = (10, 15, 20, 30, 45), (1, 2, 3), (0.5, 0.75, 1.0)
#: Usual words in both dictionaries; pieces that are counted exactly.
USUAL, COUNTED = 600, 4000
#: Bytes of a window, about; a longer word is cut. Letters of a piece. What is added to the windows' number.
WINDOW, LETTERS, FLOOR = 32, range(3, 8), 4
#: Known to both dictionaries: a window with it before it is never stored as it is.
CARRIER = b"the window of text under test: "
_WORD = re.compile(r"\w+")


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a whole text: words in a row, in lower case, of WINDOW bytes or a little more together."""
    out, held, size = set(), [], 0
    for word in _WORD.findall((text or "").lower()):
        raw = word.encode("utf-8", "replace")
        for at in range(0, len(raw), WINDOW):
            held.append(raw[at : at + WINDOW])
            size += len(held[-1]) + 1
            if size >= WINDOW:
                out.add(b" %b " % b" ".join(held))
                held, size = [], 0
    if held:
        out.add(b" %b " % b" ".join(held))
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    setup = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=13, hash_log=13, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=setup)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=setup)


class Scorer:
    """Differences of compressed lengths under one ordinary and several toxic dictionaries."""

    def __init__(self, pieces: list[list[str]], usual: list[str]):
        self.state = pieces, usual
        base = (" " + " ".join(reversed(usual)) + " ").encode("utf-8", "replace") + CARRIER
        own = [(" " + "  ".join(reversed(p)) + " ").encode("utf-8", "replace") for p in pieces]
        self.ordinary = _compressor(base)
        self.toxic = [_compressor(x + base) for x in own]

    def __reduce__(self):
        return Scorer, self.state

    def differences(self, text: str | None) -> np.ndarray:
        """Of each window (rows), under each toxic dictionary."""
        out = []
        for w in windows(text):
            w = CARRIER + w
            n = len(self.ordinary.compress(w))
            out.append([n - len(t.compress(w)) for t in self.toxic])
        return np.array(out, np.int64).reshape(-1, len(self.toxic))


def evidence(differences: np.ndarray, least: int, power: float) -> np.ndarray:
    """A text's evidence under each dictionary: differences of `least` or more, over a power of the windows' number."""
    return np.where(differences >= least, differences, 0).sum(0) / (len(differences) + FLOOR) ** power


def _pieces_of(word: Column) -> Column:
    """Beginnings and ends of a word with the space beside them, and the whole of a short one with both."""
    heads = [F.when(F.length(word) >= n, F.concat(F.lit(" "), F.substring(word, 1, n))) for n in LETTERS]
    tails = [F.when(F.length(word) >= n, F.concat(F.right(word, F.lit(n)), F.lit(" "))) for n in LETTERS]
    whole = F.when(F.length(word).between(LETTERS[0] - 1, LETTERS[-1] + 1), F.concat(F.lit(" "), word, F.lit(" ")))
    return F.array_distinct(F.array_compact(F.array(*heads, *tails, whole)))


def plain_pieces(word: str) -> set[str]:
    """The same of one word."""
    n = len(word)
    out = {f" {word[:k]}" for k in LETTERS if n >= k} | {f"{word[n - k :]} " for k in LETTERS if n >= k}
    return out | ({f" {word} "} if LETTERS[0] - 1 <= n <= LETTERS[-1] + 1 else set())


def telling(t: np.ndarray, n: np.ndarray, toxic: int, ordinary: int) -> np.ndarray:
    """Log-likelihood ratio of a piece's text counts in the two classes, negative where ordinary ones hold it more."""

    def fit(k, of, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (of - k) * np.log(1 - p)

    toxic, ordinary = max(1, toxic), max(1, ordinary)
    p, q, both = t / toxic, n / ordinary, (t + n) / (toxic + ordinary)
    gain = fit(t, toxic, p) + fit(n, ordinary, q) - fit(t, toxic, both) - fit(n, ordinary, both)
    return 2 * gain * np.where(p > q, 1, -1)


def chosen(pieces: list[str], score: np.ndarray, most: int) -> list[str]:
    """The most telling pieces, none of which has four letters in a row in common with one before it."""
    out, used = [], set()
    for k in sorted(range(len(pieces)), key=lambda k: (-score[k], -len(pieces[k]), pieces[k])):
        p = pieces[k]
        parts = {p[i : i + 4] for i in range(len(p) - 3)}
        if score[k] <= 0 or len(out) == most:
            break
        if not parts & used:
            out.append(p)
            used |= parts
    return out


def _candidates(rows: DataFrame, sizes: dict) -> tuple[list[str], list[str]]:
    """The COUNTED pieces that tell most by counts of words, and the usual words of ordinary texts; both bounded."""
    pattern = F.lit("[\\p{L}\\p{N}_]+")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), pattern, F.lit(0)))
    held = rows.select("y", F.explode(words).alias("word")).where(F.length("word") <= WINDOW)
    counts = held.groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("all"))
    counts = materialize(counts.select("word", "t", (F.col("all") - F.col("t")).alias("n")), "words")
    parts = counts.select(F.explode(_pieces_of(F.col("word"))).alias("piece"), "t", "n")
    parts = parts.groupBy("piece").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("t >= 2")
    toxic, ordinary = (sum(v for (_, y), v in sizes.items() if y == k) for k in (1, 0))
    # a word's texts, added up, stand for a piece's: the sign and order of magnitude of its ratio
    gain = F.col("t") * F.log((F.col("t") / max(1, toxic)) / ((F.col("n") + 0.5) / max(1, ordinary)))
    pieces = parts.orderBy(F.desc(gain), "piece").limit(COUNTED).select("piece").collect()
    usual = counts.where("n > 0").orderBy(F.desc("n"), "word").limit(USUAL).select("word").collect()
    return [r["piece"] for r in pieces], [r["word"] for r in usual]


def _counted(rows: DataFrame, pieces: list[str]) -> np.ndarray:
    """Texts that hold each piece, by fold and label: (FOLDS, 2, pieces); summed by partition."""
    place = {p: k for k, p in enumerate(pieces)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, len(place)), np.int64)
        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found = {place[p] for w in set(_WORD.findall(text.lower())) for p in plain_pieces(w) if p in place}
                total[fold, y, list(found)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    got = rows.select("text", "y", "fold").coalesce(16).mapInArrow(tidied(run), "sums binary").collect()  # 16 partitions at most
    return sum((np.frombuffer(r["sums"], np.int64).reshape(FOLDS, 2, -1) for r in got), np.zeros((FOLDS, 2, len(pieces)), np.int64))


class Calibrated:
    """Dictionaries, the least evidence and the power, and the thresholds between which evidence becomes a probability."""

    def __init__(self, scorer: Scorer, least: int, power: float, knots):
        self.scorer, self.least, self.power, self.knots = scorer, least, power, knots

    def score(self, text: str | None) -> float:
        found = float(evidence(self.scorer.differences(text), self.least, self.power)[0])
        return float(np.clip(np.interp(found, *self.knots), 0, 1))


def best_setting(found: np.ndarray, y: np.ndarray) -> tuple[tuple[int, int, int], tuple]:
    """Of evidence (rows, pieces, least, powers) the setting with the least loss, and its calibration."""
    best = None
    for at in np.ndindex(found.shape[1:]):
        values = found[(slice(None), *at)]
        knots = isotonic(values, y)
        p = np.clip(np.interp(values, *knots), 1e-4, 1 - 1e-4)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0] - 1e-9:
            best = loss, at, knots
    return best[1:]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 3, held: int = 1) -> Calibrated:
    """Dictionaries and calibration from about FIT_ROWS labelled rows whose crc32(doc_id as text) mod `by` is not `held`.

    Equal texts teach once, as toxic if any of their labels is. Each fold of the sample is scored under
    dictionaries of the other folds: these scores choose the toxic dictionary's size, the least evidence and the
    power, and give the calibration; the dictionaries in use are trained on all. Without rows of both labels
    every score is the labels' mean, or 0.
    """
    spark = docs.sparkSession
    rows = labelled_sample(docs, labels, label, remainder("doc_id", by) != held, FIT_ROWS, seed=6)
    rows = rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("y").alias("y"))
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "fit")
    sizes = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}  # two rows a fold
    ones, zeros = (sum(v for (_, y), v in sizes.items() if y == k) for k in (1, 0))
    if not ones or not zeros:
        return Calibrated(Scorer([[]], []), 1, 1.0, (np.array([0.0]), np.array([1.0 if ones else 0.0])))
    pieces, usual = _candidates(rows, sizes)
    counts = _counted(rows, pieces)

    def dictionaries(folds: list[int]) -> list[list[str]]:
        t, n = (counts[folds, y].sum(0) for y in (1, 0))
        of = [sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0)]
        score = telling(t.astype(float), n.astype(float), *of)
        return [chosen(pieces, score, most) for most in PIECES]

    every = list(range(FOLDS))
    tried = spark.sparkContext.broadcast([Scorer(dictionaries([f for f in every if f != own]), usual) for own in every])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = []
                for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    found = tried.value[fold].differences(text)
                    out.append(np.stack([[evidence(found, a, b) for b in POWERS] for a in LEAST], -1).T.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column(1)], names=["s", "y"])

    got = rows.select("text", "y", "fold").mapInArrow(tidied(weigh), "s array<double>, y int").toArrow()  # the bounded sample's evidence
    found = np.array(got.column(0).to_pylist()).reshape(got.num_rows, len(LEAST), len(PIECES), len(POWERS))
    (least, size, power), knots = best_setting(found, got.column(1).to_numpy().astype(float))
    return Calibrated(Scorer([dictionaries(every)[size]], usual), LEAST[least], POWERS[power], knots)


def toxicity_of(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 3, held: int = 1):
    """A function of a text column: the probability of being toxic, under a model fitted on docs and labels."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, label, by, held))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        tidy()
        return pa.array([model.value.score(t) for t in text.to_pylist()], pa.float64())

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Every whole text's probability of being toxic.

    Returns (doc_id, held_out, score, predicted), one row for each row of docs. The text alone goes into a score.
    A null or empty text has no window and gets the score of no evidence; a null doc_id is held out; repeated
    rows get the same score each; an empty table gives no rows; null labels teach nothing, and where the labels of a
    text or an id disagree, toxic holds; other columns are not read.
    """
    score = toxicity_of(docs, labels, label, by, held)
    out = F.coalesce(remainder("doc_id", by) == held, F.lit(True)).alias("held_out")
    return docs.select("doc_id", out, score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
