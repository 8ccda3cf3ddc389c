"""Near copies by the Jaccard similarity of runs of words, against brute force."""

import corpus_pipeline
import pytest
from fixtures import awkward, empty, sentence
from marketlake.llm import simhash


def plain_runs(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_similar(rows, least=0.8):
    """(doc_id, smallest id of its component) of every row with an id."""
    sets, where = [(i, plain_runs(t)) for i, t in rows if i is not None], {}
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, runs) in enumerate(sets):
        for run in runs:
            where.setdefault(run, []).append(i)
    for a, b in {(a, b) for found in where.values() for b in found for a in found if a < b}:
        if len(sets[a][1] & sets[b][1]) >= least * len(sets[a][1] | sets[b][1]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    ids = {}
    for i, (doc_id, _) in enumerate(sets):
        ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted((doc_id, ids[find(i)]) for i, (doc_id, _) in enumerate(sets))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_similar_documents_of_the_samples(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    wanted = plain_similar(rows)
    assert sorted(map(tuple, simhash.similar_documents(docs).collect())) == wanted
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, component in wanted if i == component]


def test_similar_chains_and_awkward_rows(spark):
    words = sentence(8, 200).split()
    chain = [(100 + k, " ".join(words[: -9 * k or None])) for k in range(12)]  # neighbours near, the ends not
    apart = [(200 + k, " ".join(words[:50] + sentence(50 + k, 60 + k).split())) for k in range(20)]
    repeated = [(300, sentence(30, 40)), (301, sentence(30, 40) + " x" + f" {sentence(30, 40)}" * 30)]
    docs = awkward(spark).unionByName(spark.createDataFrame(chain + apart + repeated, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(map(tuple, simhash.similar_documents(docs).collect()))
    assert got == plain_similar([(r.doc_id, r.text) for r in docs.collect()])
    assert {c for i, c in got if 100 <= i < 200} == {100}
    assert simhash.similar_documents(empty(spark)).count() == 0
    assert simhash.drop_similar(docs).filter("doc_id is null").count() == 2


def test_texts_around_a_common_passage_are_not_compared(spark, monkeypatch):
    """Pairs grow with the number of texts that share a passage, not with its square."""
    made = {}
    kept = simhash.staged

    def staged(df, name):
        made[name] = kept(df, name)
        return made[name]

    monkeypatch.setattr(simhash, "staged", staged)
    passage = sentence(1, 120)
    rows = [(k, f"{passage} " + " ".join(f"w{k}x{i}" for i in range(60))) for k in range(600)]
    near = [(1000 + k, rows[k][1] + " end") for k in range(0, 600, 50)]
    docs = spark.createDataFrame(rows + near, "doc_id long, text string")
    got = sorted(map(tuple, simhash.similar_documents(docs).collect()))
    assert got == sorted([(i, i) for i, _ in rows] + [(i, i - 1000) for i, _ in near])
    assert made["cells"].count() > 3000  # they do share cells
    assert made["pairs"].count() < 100


def test_rare_runs_lose_no_pair(spark):
    """Every two sets of the similarity share a run of theirs, whatever their sizes and what is frequent."""
    import random

    pick = random.Random(5)
    sets = {}
    for k in range(120):
        base = [pick.randrange(300) for _ in range(pick.choice([1, 2, 4, 5, 9, 10, 35, 60]))]
        for j in range(3):
            sets[3 * k + j] = sorted({pick.randrange(300) if j and pick.random() < 0.08 else x for x in base})
    nodes = spark.createDataFrame([(n, n, len(s)) for n, s in sets.items()], "node long, root long, size long")
    runs = spark.createDataFrame(list(sets.items()), "node long, runs array<long>")
    found = {}
    for r in simhash.rare_runs(nodes, runs, 0.8).collect():
        found.setdefault(r.node, {})[r.run] = r.place
    links = [(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    assert len(links) > 100
    for a, b in links:
        both = found.get(a, {}).keys() & found.get(b, {}).keys()
        assert any(min(len(sets[a]) - found[a][x], len(sets[b]) - found[b][x]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - simhash.SLACK for x in both)


def test_texts_a_little_below_the_similarity_are_not_written_as_pairs(spark, monkeypatch):
    """All share rare runs, nearly none is a link: what is written is a forest, in parts of a group too."""
    import random

    made = {}
    kept = simhash.staged

    def staged(df, name):
        made[name] = kept(df, name)
        return made[name]

    monkeypatch.setattr(simhash, "staged", staged)
    pick, base = random.Random(3), sentence(2, 200).split()
    rows = []
    for k in range(300):
        words = list(base)
        for at in pick.sample(range(10, 190, 10), 2 if k % 60 == 7 else 4):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    got = sorted(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain_similar(rows)
    assert len({c for _, c in got}) > 200
    assert made["pairs"].count() < 300
    again = simhash.forests(made["rare"], made["runs"], 0.8, part_sets=32)
    ends = lambda df: simhash.connected_components(df.unionByName(made["similar"])).groupBy("root").count().collect()
    assert sorted(r["count"] for r in ends(again)) == sorted(r["count"] for r in ends(made["pairs"]))


def test_sets_go_only_to_groups_where_they_have_a_partner(spark, monkeypatch):
    """Two sets share a passage of many rare runs: their runs are sent once, and not at all where the passage is too short."""
    made = {}
    kept = simhash.staged

    def staged(df, name):
        made[name] = kept(df, name)
        return made[name]

    monkeypatch.setattr(simhash, "staged", staged)
    sets = {}
    for k in range(40):
        both = 900 if k % 10 == 0 else 880  # 0.82 or 0.79
        shared = list(range(k * 10_000, k * 10_000 + both))
        for j in (1, 2):
            sets[2 * k + j] = shared + list(range(k * 10_000 + j * 2000, k * 10_000 + j * 2000 + 1000 - both))
    nodes = spark.createDataFrame([(n, n, 0, len(s)) for n, s in sets.items()], "node long, root long, fp long, size long")
    runs = kept(spark.createDataFrame(list(sets.items()), "node long, runs array<long>"), "runs")
    rare = kept(simhash.rare_runs(nodes, runs, 0.8), "rare")
    assert rare.count() > 5000
    edges = sorted(tuple(sorted(e)) for e in simhash.forests(rare, runs, 0.8).collect())
    assert edges == [(2 * k + 1, 2 * k + 2) for k in range(0, 40, 10)]
    assert made["members"].count() == 8
