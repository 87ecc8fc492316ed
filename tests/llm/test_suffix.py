"""The suffix-array dedup against counts of all strings, and the suffix order against a plain sort."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from toplane.llm import suffix

key = lambda r: tuple((x is not None, x) for x in r)


def plain(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return sorted(out, key=key)


def found(docs, **kw):
    return sorted(((r["doc_id"], r["n_bytes"], sum(x["bytes"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in suffix.remove_repeats(docs, ["doc_id"], **kw).collect()), key=key)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_whole_table(documents):
    assert found(documents) == plain(rows_of(documents), 200)


def test_odd_rows(odd, empty):
    assert found(odd) == plain(rows_of(odd), 200)
    assert found(empty) == []
    assert suffix.remove_repeats(odd, ["doc_id", "n_words", "lang"]).columns == ["doc_id", "n_words", "lang", "n_bytes", "removed", "kept"]


def passages(seed, n_docs):
    rng = random.Random(seed)
    bits = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        text = "".join(rng.choice(bits) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(20)) for _ in range(rng.randint(0, 12)))
        rows.append((i % (n_docs - 3), text))
    return [*rows, (900, "ab" * 300), (901, "x" * 700), (902, "ab" * 40)]


@pytest.mark.parametrize(("seed", "length", "size", "max_blocks"), [(1, 40, 12, 4000), (2, 40, 12, 3), (3, 25, 25, 4000), (4, 30, 7, 0)])
def test_passages(spark, seed, length, size, max_blocks):
    rows = passages(seed, 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(docs, length=length, size=size, max_blocks=max_blocks) == plain(rows, length)


def test_large_buckets_are_split(spark):
    """One passage inside many texts: its anchors at the edges have a block for each text."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef") for _ in range(70))
    own = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    rows = [(i, own(rng.randint(0, 60)) + passage[rng.randint(0, 5) :] + own(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, r[1][: rng.randint(30, 120)]) for i, r in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (5, 20):
        assert found(docs, length=40, size=12, max_blocks=most) == plain(rows, 40)


def test_query(spark, sf_dir, documents):
    rows = sorted(map(tuple, suffix.op3_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert rows == sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in plain(rows_of(documents), 200))


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", 500)
    rows = passages(5, 100)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), length=40, size=12) == plain(rows, 40)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    blocks = [bytes(rng.choice([97, 98], rng.integers(30, 80)).astype(np.uint8)) for _ in range(12)]
    blocks += blocks[:3]
    text = np.frombuffer(b"".join(blocks), np.uint8)
    offsets = np.cumsum([0, *map(len, blocks)])
    owner = np.concatenate([np.full(len(b) - 20, i) for i, b in enumerate(blocks)])
    starts = np.concatenate([offsets[i] + np.arange(len(b) - 20) for i, b in enumerate(blocks)])
    bucket = owner % 3
    order, _ = suffix.suffix_order(text, offsets, starts, bucket, 100)
    tail = lambda i: (bucket[i], bytes(text[starts[i] : offsets[owner[i] + 1]]))
    assert [tail(i) for i in order] == sorted(tail(i) for i in range(len(starts)))
