"""Exact, near and passage duplicates against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import awkward, empty, sentence
from marketlake.llm import exact_dedup, queries, simhash, suffix_dedup
from marketlake.llm.components import connected_components


def flat(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[flat(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[flat(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(flat(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_of_the_sample(spark, sf, documents):
    got = sorted(map(tuple, queries.op2_exact_dedup(spark, sf).collect()), key=str)
    assert got == plain_groups([(d[0], d[1]) for d in documents])


def test_exact_groups_of_awkward_rows(spark):
    docs = awkward(spark)
    from pyspark.sql import functions as F

    got = exact_dedup.duplicate_groups(docs, filter_size=4, sha=F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


def test_copies_dropped_keep_columns_and_one_of_repeated_rows(spark):
    docs = awkward(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, flat(r.text)) for r in kept.collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = {(i, flat(t)) for (i, t), (_, keep, *_x) in zip(rows, [next(g for g in plain_groups(rows) if g[0] == i and g[4] == hashlib.sha256(flat(t).encode()).hexdigest()) for i, t in rows]) if i == keep}
    assert got == Counter(dict.fromkeys(wanted, 1))
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    values = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[find(i)]) for i, (d, p) in enumerate(prints)), key=str)


def test_near_groups_of_the_sample(spark, sf, documents):
    got = sorted(map(tuple, queries.op3_simhash(spark, sf).collect()), key=str)
    assert got == plain_components([(d[0], plain_fingerprint(d[1])) for d in documents])


def test_near_groups_of_awkward_rows(spark):
    docs = awkward(spark)
    got = [(r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 7, 9, 10, 11, 12, 12, 13, 13, 14, None, None])


@pytest.mark.parametrize("blocks,part", [(6, 8), (8, 1024)])
def test_links_of_a_dense_cluster(spark, blocks, part):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = {int(center)}
    for x in rng.integers(0, 64, (300, 3)):
        fps.add(int(center) ^ (1 << int(x[0])) ^ (1 << int(x[1])) ^ (1 << int(x[2])))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100, dtype=np.uint64)}
    fps = sorted(fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long")
    edges = simhash.near_edges(table, 4, blocks, part).collect()
    assert all(((e.a ^ e.b) % (1 << 64)).bit_count() >= 1 for e in edges)
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges or [], "a long, b long")).collect()}
    signed = [r.fp for r in table.collect()]
    got = defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x % (1 << 64))
    wanted = defaultdict(set)
    for i, _, root in plain_components(list(enumerate(fps))):
        wanted[root].add(fps[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1050)}


def plain_passages(rows, least=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        spans = []
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        if spans:
            out.append((doc_id, ",".join(f"{a}:{b}" for a, b in spans), len(w), sum(b - a for a, b in spans)))
    return sorted(out, key=str)


def test_passages_of_the_sample(spark, sf, documents):
    got = sorted(map(tuple, queries.op8_suffix_dedup(spark, sf).collect()), key=str)
    assert got == plain_passages([(d[0], d[1]) for d in documents])
    assert got


def test_passages_of_awkward_rows(spark):
    docs = awkward(spark)
    extra = spark.createDataFrame([(20, "so " * 120), (21, sentence(6, 50)), (22, "a " + sentence(6, 50) + " b")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    for least, seed in ((50, 26), (20, 7)):
        found = suffix_dedup.repeated_passages(docs, least=least, seed=seed).collect()
        got = [(r.doc_id, ",".join(f"{s.start}:{s.end}" for s in r.spans), r.n_words, r.n_repeated) for r in found]
        assert sorted(got, key=str) == plain_passages([(r.doc_id, r.text) for r in docs.collect()], least)
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0
