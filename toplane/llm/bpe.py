"""BPE encoding and decoding, byte level.

Encoding: a text is cut at special tokens, then by the vocabulary's pattern into
pieces; a piece's bytes are a doubly linked list of symbols, and a priority queue
holds (rank, position) of the merges that its neighbours allow.  The lowest
rank is merged first, leftmost among equals; an entry whose symbols have
changed since is stale and skipped.  Pieces repeat, so each task keeps a table
of those it has encoded, bounded in entries and in the length of each.  Decoding
concatenates the vocabulary's byte strings and reads them as UTF-8, with U+FFFD
for what is not.

A null text is empty and gives no tokens; a long one is encoded whole.  Repeated
rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from toplane.llm.shared import extended, in_batches, keyed, named, table
from toplane.llm.token_counts import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Pieces of text, as the byte-level pre-tokenizer cuts them.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a task knows at most, twice over: when the newer table is full, it takes the place of the older one.
MAX_PIECES = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.strings = {i: bytes(letters[c] for c in word) for word, i in vocab.items() if all(c in letters for c in word)}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.strings |= {i: s.encode() for s, i in self.specials.items()}
        self.first = [vocab.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: (left id, right id) → (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        merges = self.merges
        ids = [self.first[b] for b in raw]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], made, ids[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], made))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def piece(self, text: str) -> tuple[int, str, bytes]:
        """(tokens, their ids as text, what they decode to) of a piece that the newer table doesn't hold."""
        found = self.older.get(text)
        if found is None:
            ids = self.merge(text.encode())
            found = (len(ids), ",".join(map(str, ids)), self.join(ids))
        if len(text) <= 64:
            if len(self.known) >= MAX_PIECES:
                self.older, self.known = self.known, {}
            self.known[text] = found
        return found

    def forget(self) -> None:
        """Frees the table of pieces, as at the end of a task: workers live on."""
        self.known, self.older = {}, {}

    def join(self, ids: list[int]) -> bytes:
        strings = self.strings
        return b"".join([strings[i] for i in ids])

    def parts(self, text: str) -> list[tuple[int, str, bytes]]:
        out = []
        get, make = self.known.get, self.piece
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                i = self.specials[part]
                out.append((1, str(i), self.strings[i]))
            else:
                out += [get(p) or make(p) for p in self.pieces.findall(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.join(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str = VOCABULARY) -> Codec:
    """Made once in each process."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary_path(vocabulary))
    return _codecs[vocabulary]


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """docs with a column of token ids."""
    schema = extended(docs.schema, f"`{ids_col}` array<int>")
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = pa.array([own.encode(x.as_py() or "") for x in batch.column(where)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)
        own.forget()

    return in_batches(docs, run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, text_col: str = "decoded") -> DataFrame:
    """docs with a column of the text that the ids stand for (null ids: empty)."""
    schema = extended(docs.schema, f"`{text_col}` string")
    where = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = pa.array([own.decode(x.as_py() or []) for x in batch.column(where)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return in_batches(docs, run, schema)


def digests(docs: DataFrame, keys: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The key columns of each row, n_tokens, ids_sha256 and decoded_sha256; ids and texts stay where they are made."""
    inner, names, where = keyed(docs, keys, text_col)
    schema = extended(inner.select(*names).schema, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            n, ids, texts = [], [], []
            for x in batch.column(where):
                parts = own.parts(x.as_py() or "")
                n.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=schema.names)
        own.forget()

    return named(in_batches(inner, run, schema), names, keys, "n_tokens", "ids_sha256", "decoded_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), ["doc_id"])
