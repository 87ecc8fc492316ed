"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Base kinds, leftmost and not overlapping within a kind:
assign  a name such as password or token, a sign, and a value of 8+ characters
access  `AKIA[A-Z0-9]+` of 16+ characters
hex     `[0-9a-f]+` of 32+ characters

The method adds kind `random`: runs of `[A-Za-z0-9+/_=-]` of MIN_RANDOM
characters or more that a tiktoken vocabulary encodes, whole, in fewer than
MAX_RATIO characters a token, and that have a letter and a digit or are a single
run of letters.  Known digests (hex of the usual digest lengths, UUIDs) and
identifiers (separated words, dates, version or host names, words with a short
number) are left out, and so is a run that touches a base span.  Spans are in
code points, end exclusive.

Null is an empty text; a long one is searched whole.  Ties at one start go by kind in the order above.
Repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.shared import extended, in_batches, keyed, named, table
from toplane.llm.token_counts import VOCABULARY, encoding

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_NAME = re.compile(r"(?ai:passw(?:or)?d|secret|token|api_?key)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Fixed order of the kinds.
KINDS = ("assign", "access", "hex", "random")

MIN_RANDOM, MAX_RATIO = 20, 2.2
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
#: Words or numbers joined by separators, or a word with a short number: names rather than random strings.
IDENTIFIER = re.compile(r"(?:(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*|[A-Za-z]{2,}[0-9]{1,4})\Z")
#: One run of letters, padded or not: whether it is a word or random, only the ratio can tell.
LETTERS = re.compile(r"[A-Za-z]+=*\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, in that order."""
    out = []
    if ASSIGN_NAME.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, taken: list[tuple[int, int, int]], encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Runs that the vocabulary encodes badly, apart from known digests, identifiers and what is taken."""
    out = []
    for m in RANDOM.finditer(text):
        run, a, b = m.group(), m.start(), m.end()
        if not LETTERS.match(run) and (not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)) or DIGEST.match(run) or IDENTIFIER.match(run)):
            continue
        if any(x < b and a < y for x, _, y in taken):
            continue
        if len(run) < max_ratio * len(encode(run)):
            out.append((a, 3, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, keys: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The key columns of each row, n_assign, n_access, n_hex, n_random, base (the base spans as text) and spans (all)."""
    inner, names, where = keyed(docs, keys, text_col)
    schema = extended(inner.select(*names).schema, "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base string, spans string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            rows = []
            for x in batch.column(where):
                text = x.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, encode, max_ratio)
                count = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((*count, len(more), written(base), written(sorted(base + more))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=schema.names)

    return named(in_batches(inner, scan, schema), names, keys, "n_assign", "n_access", "n_hex", "n_random", "base", "spans")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
