"""The pipeline against a plain version of its five stages, on a whole small table."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from toplane.llm import linededup

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain(docs, items):
    from itertools import combinations

    import public_tokenizers
    from tokenizers import Tokenizer

    # 1: without a letter there is no language
    docs = [r for r in docs if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    # 2
    pages, held = Counter(r["source"] for r in docs), defaultdict(Counter)
    for r in docs:
        held[r["source"]].update({x for x in r["text"].split("\n") if x.strip(" ")})
    bad = {(s, x) for s in held for x, n in held[s].items() if n >= linededup.MIN_PAGES and n > linededup.MAX_RATIO * pages[s]}
    docs = [{"doc_id": r["doc_id"], "text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)} for r in docs]
    # 3
    sets = []
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)), key=lambda k: docs[k]["doc_id"])
            root[b] = a
    docs = [r for i, r in enumerate(docs) if find(i) == i]
    # 4
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    windows = set()
    for t in items:
        w = word.findall(low(t))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    kept = []
    for r in docs:
        spans = [m.span() for m in word.finditer(low(r["text"]))]
        w = [low(r["text"])[a:b] for a, b in spans]
        hit = set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if len(hit) > 0.5 * len(w):
            continue
        gone = set()
        for i in hit:
            gone |= set(range(*spans[i]))
            if i + 1 in hit:
                gone |= set(range(spans[i][1], spans[i + 1][0]))
        # windows that only stand next to each other are one run
        kept.append((r["doc_id"], "".join(c for k, c in enumerate(r["text"]) if k not in gone)))
    # 5
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    return sorted(out)


def test_pipeline_matches_the_plain_version(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == plain(docs, items)


def test_stages_return_documents(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, sf_dir)
            assert out.columns == list(corpus_pipeline.COLUMNS), k
            assert out.count() <= docs.count()
