"""Toxicity: Levenshtein automata over a learned lexicon trie, and context windows.

Learning takes a bounded sample of labelled rows (MAX_TRAIN, chosen by a hash of
doc_id).  Words, and beginnings of words, that toxic texts hold far more often
than clean ones make the lexicon.  Its trie is intersected with the Levenshtein
automaton of distance 1 (terms of FUZZY_LENGTH letters or more); the product is
made deterministic as words walk it.  Words within distance 1 of a term that
clean training texts use are no misspellings.

Each hit is read with CONTEXT words on either side: one inside quotation marks,
or beside a word of reporting, counts as quoted, and not as abuse: how many
hits there are, how different and how dense, is counted over the others.  A
logistic regression over these features gives the score, so where the labelled
rows hold no quoted hit, a text of nothing but quoted hits scores like one
without hits.  Learned beginnings of words, and terms of fewer than
FUZZY_LENGTH letters, are matched as they are: one edit away from them lie too
many words of other meanings.

The sample is bounded, and so is what can be learned from it: the MAX_TERMS
terms with the most evidence.  Scoring reads all texts whole, long ones too.

Null and empty texts get the score of a text without hits.  With no labels of
one of the two kinds, every score is 0.  Repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.language import fold
from toplane.llm.shared import extended, in_batches, keyed, named, table

#: Labelled rows that are learned from, and terms of the lexicon, at most.
MAX_TRAIN, MAX_TERMS = 12_000, 2_000
#: Beginnings of words of these lengths are looked at beside whole words.
PREFIXES = (5, 6, 7, 8)
MIN_DOCS, MIN_ODDS = 4, 8.0
FUZZY_LENGTH, CONTEXT = 5, 5
FOLDS, THRESHOLD = 3, 0.7
MAX_KNOWN = 500_000
WORD = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+)*")
#: Words of reporting speech, fixed.
REPORTING = frozenset("said says wrote writes quoted quote quotes called".split())
QUOTES = "\"“”„«»"


class Lexicon:
    """Terms (whole words, or beginnings that end in *) with weights, and the automaton over their trie."""

    def __init__(self, terms: dict[str, float], clean: frozenset[str] = frozenset()) -> None:
        self.clean = clean
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[str, float] | None] = [None]
        self.prefix: list[tuple[str, float] | None] = [None]
        for term, weight in sorted(terms.items()):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.prefix.append(None)
                node = self.children[node][c]
            (self.prefix if term.endswith("*") else self.word)[node] = (term, weight)
        self.alphabet = {c for x in self.children for c in x}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.known: dict[str, tuple | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of (trie node, edits), with the nodes that a missing letter leads to."""
        least: dict[int, int] = {}
        for node, edits in pairs:
            least[node] = min(edits, least.get(node, 2))
        for node, edits in list(least.items()):
            if not edits:
                for child in self.children[node].values():
                    least[child] = min(1, least.get(child, 2))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            found = []
            for node, edits in key:
                if (x := self.word[node]) and (not edits or len(x[0]) >= FUZZY_LENGTH):
                    found.append((edits, -x[1], x[0]))
            self.accepts.append(min(found, default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        """The state after one more letter; -1 if none is left."""
        pairs = set()
        for node, edits in self.members[state]:
            if c in self.children[node]:
                pairs.add((self.children[node][c], edits))
            if not edits:
                pairs.add((node, 1))
                pairs |= {(child, 1) for child in self.children[node].values()}
        self.moves[state][c] = to = self._state(pairs) if pairs else -1
        return to

    def look(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelled) of a word, or None."""
        if word in self.known:
            return self.known[word]
        best, node = None, 0
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            if self.prefix[node]:
                best = max(best or (0.0, False), (self.prefix[node][1], False))
        state = self.start
        for c in word:
            c = c if c in self.alphabet else "\0"
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
        if state >= 0 and (found := self.accepts[state]):
            if not found[0]:
                best = max(best or (0.0, False), (-found[1], False))
            elif best is None and word not in self.clean:
                best = (-found[1], True)
        if len(self.known) >= MAX_KNOWN:
            self.known.clear()
        self.known[word] = best
        return best


def features(text: str, lexicon: Lexicon) -> list[float]:
    """1, then log(1 + x) of: weights of exact hits, of misspelled ones, of quoted ones, hits that aren't quoted per hundred words, how many different ones; and 1 if any exact hit."""
    low = text.lower()
    look = lexicon.look
    hits = {w: x for w in set(WORD.findall(low)) if (x := look(w))}
    if not hits:
        return [1.0, 0, 0, 0, 0, 0, 0]
    exact = fuzzy = quoted = 0.0
    spans = [(m.group(), m.start()) for m in WORD.finditer(low)]
    n, different = 0, set()
    for i, (w, at) in enumerate(spans):
        if w not in hits:
            continue
        weight, near = hits[w]
        around = spans[max(0, i - CONTEXT) : i + CONTEXT + 1]
        lo, hi = around[0][1], around[-1][1] + len(around[-1][0])
        before, after = low[lo:at], low[at + len(w) : hi]
        if any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or any(x in REPORTING for x, _ in around):
            quoted += weight
            continue
        n += 1
        different.add(w)
        if near:
            fuzzy += weight
        else:
            exact += weight
    return [1.0, float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(quoted)), float(np.log1p(100 * n / len(spans))), float(np.log1p(len(different))), float(exact > 0)]


N_FEATURES = 7


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def learn(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[Lexicon, np.ndarray | None]:
    """The lexicon and the regression's coefficients (None if one kind of label is missing).

    labels may name an id more than once; its largest label counts.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), train.alias("train")).filter("train and y is not null and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", F.coalesce("text", F.lit("")).alias("text")).repartition(8).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for y, x in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found[int(y > 0)].update(terms_of(x))
        terms = sorted(found[0].keys() | found[1].keys())
        for lo in range(0, len(terms), 50_000):
            part = terms[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[0][t] for t in part], pa.int64()), pa.array([found[1][t] for t in part], pa.int64())], names=["term", "clean", "toxic"])

    kinds = {int(r["y"] > 0): r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Lexicon({}), None
    odds = ((F.col("toxic") + 0.5) / (kinds[1] + 1)) / ((F.col("clean") + 0.5) / (kinds[0] + 1))
    counted = in_batches(rows, count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counted.filter(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS).orderBy(F.desc(F.col("toxic") * F.log("odds")), "term").limit(max(MAX_TERMS, 1)).collect()
    terms = {r["term"]: float(np.log(r["odds"])) for r in best}
    rough = Lexicon(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for y, x in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if y <= 0:
                    found |= {w for w in set(WORD.findall(x.lower())) if (hit := rough.look(w)) and hit[1]}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    clean = frozenset(r["word"] for r in in_batches(rows, near, "word string").distinct().collect())
    lexicon = Lexicon(terms, clean)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x, lexicon) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.float64()), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    seen = in_batches(rows, measure, "y double, x array<double>").collect()
    rows.unpersist()
    return lexicon, regression(np.array([r["x"] for r in seen]), np.array([float(r["y"] > 0) for r in seen]))


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray | None, keys: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The key columns of each row, score and predicted."""
    inner, names, where = keyed(docs, keys, text_col)
    schema = extended(inner.select(*names).schema, "score double, predicted int")
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = sent.value
        for batch in batches:
            if w is None:
                found = [0.0] * batch.num_rows
            else:
                x = np.array([features(x.as_py() or "", own) for x in batch.column(where)]).reshape(-1, N_FEATURES)
                found = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=schema.names)

    return named(in_batches(inner, run, schema), names, keys, "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon, weights = learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", FOLDS) != 1)
    return score(docs, lexicon, weights, ["doc_id"]).select("doc_id", (fold("doc_id", FOLDS) == 1).alias("held_out"), "score", "predicted")
