"""Language ID by error-correcting output codes over byte trigrams.

Each learned language has a codeword; one binary classifier for each bit tells
the languages with a 1 from those with a 0 by the mean log-odds of a text's
byte trigrams (hashed, lower case, other than letters as spaces).  Decoding
weights each bit's loss by how well its classifier separates the training
languages, and takes the codeword with the least loss; the score is the
softmax of the negative losses.  A text is flagged as ambiguous if its two best
codewords are close, or if its bits disagree with the chosen codeword in more
places than the code corrects (half the least distance of two codewords): most
such texts mix languages.

Only the trigram counts of a bounded sample (MAX_TRAIN rows, whole texts, chosen
by a hash of doc_id) are learned.  lang, source and doc_id are never inputs of
a prediction.  `und` with score 0, and ambiguous: null texts, texts without a
letter, and all texts if there is nothing to learn from.  Long texts are scored
whole.  Repeated rows each give a row; ties
between codewords go to the language first in order; a null doc_id counts as
empty text in the folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.shared import extended, in_batches, keyed, named, table
from toplane.llm.textops import chunks, owners

TABLE_BITS = 16
#: Rows that the classifiers learn from, at most.
MAX_TRAIN = 4000
FOLDS = 5
#: Below this score a text is flagged as ambiguous.
AMBIGUOUS = 0.6
UNDETERMINED = "und"

#: Lower case for letters, bytes of other scripts as they are, a space for the rest.
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
PLAIN[0x80:] = np.arange(0x80, 0x100)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the texts, each with a space before and after, and where each text's begin and end."""
    n, docs = len(data), len(offsets) - 1
    spaced = np.full(n + docs + 1, 0x20, np.uint8)
    spaced[np.arange(n) + owners(offsets) + 1] = PLAIN[data]
    wide = spaced.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:] if len(wide) > 2 else np.zeros(0, np.uint32)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    # the first trigram of text d stands at its leading space; the one at its last byte belongs to no text
    return code, np.stack([offsets[:-1], offsets[1:]], 1) + np.arange(docs)[:, None]


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of 0 and 1: all useful columns up to five languages, else the best of some seeded random codes."""
    if k <= 1:
        return np.zeros((k, 0), np.int8)
    if k <= 5:
        columns = range(1, 2 ** (k - 1))
        return np.array([[1 if i == 0 else (c >> (i - 1)) & 1 ^ 1 for c in columns] for i in range(k)], np.int8)
    bits = 4 * int(np.ceil(np.log2(k))) + 3
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (k, bits)).astype(np.int8)
        if (code.all(0) | ~code.any(0)).any():
            continue
        least = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(k), 2))
        if least > far:
            best, far = code, least
    return best


class Model:
    """Languages, their codewords, and the log-odds of each trigram for each bit."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        bits = self.code.shape[1]
        share = np.stack([counts[x] / max(counts[x].sum(), 1) for x in self.languages]) if counts else np.zeros((0, 1))
        rare = 1e-6
        apart = [int((self.code[a] != self.code[b]).sum()) for a in range(len(self.code)) for b in range(a)]
        #: Wrong bits that the code corrects.
        self.radius = (min(apart, default=1) - 1) // 2
        self.odds = np.zeros((1 << TABLE_BITS, bits), np.float32)
        for b in range(bits):
            one, none = share[self.code[:, b] == 1].mean(0), share[self.code[:, b] == 0].mean(0)
            self.odds[:, b] = np.log((one + rare) / (none + rare))
        # how far each classifier's mean lies on the right side, for its worst language
        mean = share @ self.odds if bits else np.zeros((len(share), 0))
        signed = mean * (2 * self.code - 1)
        self.weight = np.clip(signed.min(0), 0.05, None) if bits else np.zeros(0)
        self.weight = self.weight / self.weight.sum() * bits if bits else self.weight

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) from each text's margins by bit."""
        if not self.languages:
            raise ValueError("there is nothing to learn from")
        signs = 2.0 * self.code - 1
        loss = (self.weight * np.logaddexp(0, -margins[:, None, :] * signs[None])).sum(2)
        best = loss.argmin(1)
        gap = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / gap.sum(1)
        wrong = ((margins > 0) != (self.code[best] == 1)).sum(1)
        return best, score, (score < AMBIGUOUS) | (wrong > self.radius)

    def predict(self, column: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, flags = [], [], []
        for _, _, data, offsets in chunks(column):
            code, spans = trigrams(data, offsets)
            length = np.diff(offsets)
            full = np.flatnonzero(length)
            margins = np.zeros((len(length), self.code.shape[1]))
            if len(full) and margins.shape[1]:
                cuts = np.append(spans[full].ravel(), len(code))
                cuts = np.minimum(cuts, len(code) - 1)
                total = np.add.reduceat(self.odds[code], cuts, 0)[: 2 * len(full) : 2]
                margins[full] = total / np.sqrt(length[full])[:, None]
            best, score, ambiguous = self.decode(margins)
            langs += [self.languages[i] for i in best]
            scores += score.tolist()
            flags += ambiguous.tolist()
        return langs, scores, flags


def learn(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """A model from at most max_train rows of docs for which `train` holds and lang and text are not null."""
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), train.alias("train")).filter("train and lang is not null and text is not null")
    chosen = inner.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max_train).select("id")
    rows = inner.join(F.broadcast(chosen.distinct()), "id", "left_semi").select("text", "lang").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, _, data, offsets in chunks(batch.column("text")):
                code, spans = trigrams(data, offsets)
                for i, (a, b) in enumerate(spans.tolist()):
                    own = found.setdefault(langs[lo + i], np.zeros(1 << TABLE_BITS, np.int64))
                    own += np.bincount(code[a:b], minlength=1 << TABLE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in in_batches(rows, count, "lang string, counts binary").collect():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"], np.int64)
    return Model(total)


def identify(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns of each row, lang_pred, score, ambiguous."""
    inner, names, where = keyed(docs, keys, text_col)
    schema = extended(inner.select(*names).schema, "lang_pred string, score double, ambiguous boolean")
    inner = inner.withColumn("has_letter", F.coalesce(inner[inner.columns[where]].rlike(r"\p{L}"), F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            letters = batch.column("has_letter").to_pylist()
            if own.languages:
                langs, scores, flags = own.predict(batch.column(where))
            else:
                langs, scores, flags = [UNDETERMINED] * len(letters), [0.0] * len(letters), [True] * len(letters)
            rows = [(a, b, c) if ok else (UNDETERMINED, 0.0, True) for a, b, c, ok in zip(langs, scores, flags, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=schema.names)

    return named(in_batches(inner, run, schema), names, keys, "lang_pred", "score", "ambiguous")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, fold("doc_id", FOLDS) != 0)
    return identify(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
