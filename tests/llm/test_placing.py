"""Shards and mixtures."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import awkward, empty
from marketlake.llm import mixing, queries, sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_shard(None, 0)


def check_shards(rows, texts):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts if i is not None
    )
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(s) == 1 for s in by_id.values())


def test_shards_of_the_sample(spark, sf, documents):
    rows = queries.op1_sharding(spark, sf).collect()
    check_shards(rows, [(d[0], d[1]) for d in documents])
    assert {r.grown_shard for r in rows} > {40}


def test_shards_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = sharding.shard_documents(docs, 40).collect()
    assert len(rows) == docs.count()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sharding.shard_documents(empty(spark), 40).count() == 0


@pytest.mark.parametrize("parts", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {f"s{i}": 1 + i % 5 for i in range(20)}])
def test_period_deviates_by_less_than_a_block(parts):
    total = sum(parts.values())
    slots = mixing.period(parts, parts)
    assert sorted(s for x in slots.values() for s in x) == list(range(total))
    for s, q in parts.items():
        assert slots[s] == sorted(slots[s])
        for i, at in enumerate(slots[s]):  # within the window of its release and deadline
            assert i * total // q <= at < -(-(i + 1) * total // q)
        done = 0
        for t in range(1, total + 1):
            done += t - 1 in slots[s]
            assert abs(done - t * q / total) < 1


def plain_schedule(parts, blocks):
    """The source of every slot, one period after the other: of the blocks released, the one with the earliest deadline.
    A period has the blocks that the sources still have, as many as their parts at most."""
    left, out = dict(blocks), []
    while any(left.values()):
        live = [s for s in parts if left[s]]
        total = sum(parts[s] for s in live)
        jobs = {(-(-(i + 1) * total // parts[s]), s, i * total // parts[s]) for s in live for i in range(min(parts[s], left[s]))}
        clock = 0
        while jobs:
            ready = [job for job in jobs if job[2] <= clock]
            if ready:
                jobs.remove(min(ready))
                out.append(min(ready)[1])
                left[out[-1]] -= 1
            clock += 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_whole_schedule_is_the_plain_one(seed):
    """All slots, also after sources have run out."""
    import random

    rng = random.Random(seed)
    parts = {f"s{i}": rng.randrange(1, 9) for i in range(rng.randrange(1, 6))}
    blocks = {s: rng.choice([0, 1, 3, rng.randrange(60)]) for s in parts}
    got = {}
    for s, found in mixing.segments(parts, blocks).items():
        for first, many, slot, length, take, slots in found:
            for i in range(many):
                assert slot + i // take * length + slots[i % take] not in got
                got[slot + i // take * length + slots[i % take]] = (s, first + i)
    assert [got[i][0] for i in range(len(got))] == plain_schedule(parts, blocks)
    for s in parts:
        assert [b for i in range(len(got)) for name, b in [got[i]] if name == s] == list(range(blocks[s]))


def check_mix(rows, parts, block_rows):
    blocks = defaultdict(lambda: defaultdict(list))
    for r in rows:
        blocks[r.mix_source][r.mix_block].append(r)
    slot_of = {}
    for source, own in blocks.items():
        assert sorted(own) == list(range(len(own)))
        for b, members in own.items():
            assert len({m.mix_slot for m in members}) == 1
            assert sorted(m.mix_place for m in members) == list(range(len(members)))
            assert len(members) == block_rows or b == len(own) - 1
            slot_of[members[0].mix_slot] = source
    assert sorted(slot_of) == list(range(sum(map(len, blocks.values()))))
    # until the first source runs out, none deviates by a whole block
    live = {s: parts[s] for s in blocks}
    done = dict.fromkeys(blocks, 0)
    for t in range(len(slot_of)):
        done[slot_of[t]] += 1
        if any(done[s] == len(blocks[s]) for s in blocks):
            break
        assert all(abs(done[s] - (t + 1) * q / sum(live.values())) < 1 for s, q in live.items())
    return t


def test_mix_of_the_sample(spark, sf, documents):
    rows = queries.op4_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in documents)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    parts = {"src0": 3, "src1": 2, "src2": 2, mixing.REST: 9}
    rows = mixing.mix(docs, parts, rest=9, block_rows=2).collect()
    assert check_mix(rows, parts, 2) > 8
    in_order = [r.doc_id for r in sorted(rows, key=lambda r: (r.mix_slot, r.mix_place))]
    again = mixing.mixed_order(spark.read.parquet(f"{sf}/documents.parquet"), parts, rest=9, block_rows=2)
    assert [r.doc_id for r in again.collect()] == in_order
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs, {"src0": 2, "src3": 1, "absent": 5}, block_rows=1).collect()
    assert len(rows) == docs.count()
    assert sorted(r.mix_slot for r in rows) == list(range(docs.count()))
    assert {r.mix_source for r in rows} == {"src0", "src3", mixing.REST}
    assert mixing.mix(empty(spark), {"src0": 2}).count() == 0
    assert mixing.mixed_order(docs, {"src0": 2}).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0})
