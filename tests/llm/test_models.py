"""Search, secrets, languages, pieces and URL rules."""

import fnmatch
import hashlib
import re

import compare
import numpy as np
import pytest
from fixtures import awkward, empty, sentence
from marketlake.llm import language, multi_index, oracle, queries, secret_scan, sentence_pieces, url_filter
from pyspark.sql import functions as F


def plain_nearest(vectors, k=20):
    clean = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v]
    clean = [(i, v) for i, v in clean if np.isfinite(v).all() and v.any()]
    out = {}
    for q, v in clean:
        if q % 20 == 0:
            scored = sorted(((-float((v * w).sum()), i) for i, w in clean if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def check_nearest(rows, wanted, least):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert set(found) == {q for q, w in wanted.items() if w}
    hits = 0
    for q, got in found.items():
        assert got == sorted(got, key=lambda x: (-x[1], x[0])) and len(got) == len(wanted[q])
        exact = dict(wanted[q])
        hits += len(exact.keys() & {i for i, _ in got})
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got if i in exact)
    assert hits >= least * sum(map(len, wanted.values()))


def test_nearest_of_the_sample(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_nearest(queries.op5_multi_index(spark, sf).collect(), plain_nearest(vectors), 0.9)


def test_nearest_of_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(300, 500)]
    rows += [(None, [1.0] * 6), (1001, None), (1002, [0.0] * 6), (1003, [float("nan")] + [1.0] * 5), (1004, [float("inf")] * 6), (1005, [None] + [1.0] * 5)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = multi_index.nearest(table, F.col("vec_id") % 20 == 0, centroids=4, probe=1.0, chunk_rows=64).collect()
    wanted = plain_nearest(rows)
    check_nearest(got, wanted, 1.0)
    ties = [r.vec_id for r in got if r.query_id == 300]
    assert sorted(ties) == [i for i, _ in sorted(wanted[300])]
    few = multi_index.nearest(table.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in few] == [1, 2]
    assert multi_index.nearest(table.filter("vec_id > 9999"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    # a repeated id with two vectors, a row repeated whole, and vectors of other lengths, one of them a query's
    rows += [(20, rng.normal(size=6).tolist()), (40, rows[40][1]), (7, rows[40][1]), (80, [1.0] * 5), (81, [9.0] * 7), (82, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest(table, F.col("vec_id") % 20 == 0, k=3, centroids=3, probe=1.0).collect()
    known = [(i, np.array(v)) for i, v in rows if len(v) == 6]
    wanted = []
    for at, (q, v) in enumerate(known):
        if q % 20 == 0:
            scored = sorted((-float((v * w).sum()), i) for other, (i, w) in enumerate(known) if other != at)[:3]
            wanted += [(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(wanted)
    assert [r[0] for r in wanted].count(20) == [r[0] for r in wanted].count(40) == 6  # each row has its own ranking


def test_visits_follow_the_vectors(spark, monkeypatch):
    """Vectors in clusters need few entries, others many; the neighbours are found either way."""
    wanted, fit = [], multi_index.nearest_cells

    def cells(entries, ids, vectors, k):
        found = fit(entries, ids, vectors, k)
        wanted.append([entries, ids, vectors, found])
        return found

    monkeypatch.setattr(multi_index, "nearest_cells", cells)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8))
    for spread in (0.01, 3.0):
        rows = [(i, (centres[i % 40] + spread * rng.normal(size=8)).tolist()) for i in range(2000)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        check_nearest(multi_index.nearest(table, F.col("vec_id") % 20 == 0, centroids=8).collect(), plain_nearest(rows), 0.9)
    for entries, ids, vectors, found in wanted:  # the trials' neighbours are those of brute force
        all_ = [(r.vec_id, r.cell, np.array(r.v)) for r in entries.collect()]
        for trial in (0, 5):
            scored = sorted((-float(vectors[trial] @ v), i, c) for i, c, v in all_ if i != ids[trial])[:20]
            assert sorted(c for t, c in found if t == trial) == sorted(c for _, _, c in scored)
    counts = rng.integers(0, 9, (7, 5))
    a, b = rng.normal(size=7), rng.normal(size=5)
    before = multi_index.needed(a, b, counts).reshape(7, 5)
    for enough in (1, 10, 60):
        assert ((before < enough) == multi_index.visit(a, b, counts, enough)).all()


def test_cells_are_visited_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=7), rng.normal(size=5)
    sums = np.sort((a[:, None] + b[None, :]).ravel())[::-1]
    for wanted in (1, 4, 17, 35):
        seen = multi_index.visit(a, b, np.ones((7, 5), int), wanted)
        assert sorted((a[:, None] + b[None, :])[seen])[::-1] == pytest.approx(sums[:wanted].tolist())


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_base_secrets_of_the_sample(spark, sf, documents):
    rows = {r.doc_id: r for r in queries.op6_secrets(spark, sf).collect()}
    assert len(rows) == len(documents)
    for doc_id, text, *_ in documents:
        base = plain_base(text)
        as_text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[doc_id].base_sha256 == hashlib.sha256(as_text.encode()).hexdigest()
        assert (rows[doc_id].n_assign, rows[doc_id].n_access, rows[doc_id].n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(as_text.split(",")) - {""} <= set(rows[doc_id].spans.split(","))


TRICKY = [
    "token: token: abcdef", "PASSWORD = 'Abc=_9' api_key=\"short\" apikey:abcdefghi", "passwordsecret=aaaaaa=bbbbbb", "AKIA" + "AKIA" * 6,
    "AKIASHORT AKIA" + "Z" * 16, "é\U0001f600 secret=zzzzzzz", "0123456789abcdef" * 3 + "g" + "f" * 23, "password=" * 2000 + "x", "a" * 5000,
]


def test_tricky_secrets(spark):
    docs = awkward(spark).unionByName(
        spark.createDataFrame(list(enumerate(TRICKY, 100)), "doc_id long, text string"), allowMissingColumns=True)
    texts = [r.text for r in docs.collect()]
    found = secret_scan.find_secrets(docs).collect()
    got = sorted(str((r.doc_id, [(s.start, s.kind, s.end) for s in r.base])) for r in found)
    ids = [r.doc_id for r in docs.collect()]
    assert got == sorted(str((i, plain_base(t))) for i, t in zip(ids, texts, strict=True))
    assert secret_scan.find_secrets(empty(spark)).count() == 0


def test_markov_models_tell_random_strings_from_identifiers(spark):
    rng = np.random.default_rng(5)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(200)]
    keys = ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16)) for _ in range(200)]
    rows = [f"{sentence(i, 40)} token={a} {b} {sentence(i + 999, 30)}" for i, (a, b) in enumerate(zip(hexes, keys, strict=True))]
    # ordinary text has capitals and numbers too, else the model knows nothing of what follows them
    plain = [f"{sentence(i + 5000, 60)} {sentence(i + 7000, 20).title()} {sentence(i, 9).upper()} {1900 + i} {i * 7919}" for i in range(200)]
    base64 = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 36))
    rows += [*plain, f"see {base64} here", "see thequickbrownfoxandthelazydogrunsto2dens here"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    extra = {r.doc_id: [s.value for s in r.extra] for r in secret_scan.find_secrets(docs).collect() if r.extra}
    assert extra == {400: [base64]}


def test_language_of_the_held_out(spark, sf, documents):
    import zlib

    rows = {r.doc_id: r for r in queries.op9_language(spark, sf).collect()}
    assert len(rows) == len(documents)
    right = total = 0
    for doc_id, text, lang, _ in documents:
        r = rows[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and len(text) > 40:
            total, right = total + 1, right + (r.lang_pred == lang)
    assert right >= 0.97 * total


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    prototypes = language.learn(language.training_rows(docs))
    assert set(prototypes) <= {"en", "fr", "de"} and "en" in prototypes
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, prototypes).collect()]
    assert len(got) == docs.count()
    assert {i for i, lang in got if lang == "und"} == {4, 5, 6, 14, None}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.learn(empty(spark)) == {} and language.identify(empty(spark), prototypes).count() == 0


def test_labels_are_no_inputs_of_a_prediction(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prototypes = language.learn(language.training_rows(docs))
    one = {r.lang_pred for r in language.identify(docs.limit(1), prototypes).collect()}
    two = {r.lang_pred for r in language.identify(docs.limit(1).withColumn("lang", F.lit("xx")), prototypes).collect()}
    assert one == two


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load_pieces(queries.piece_model())


TEXTS = ["", " ", "Hello world", "  two  spaces ", "a\nb\n\n c\t\r\n", "naïve Übergröße 日本語 \U0001f600", "x" * 3000, "don't stop; ok}\r\n", "1234567 890", "the the the"]


def test_pieces_round_trip_and_best_path(spark, pieces):
    from sentencepiece import SentencePieceProcessor

    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    whole = sentence_pieces.encode(docs, pieces)
    by_task = sentence_pieces.encode(docs, pieces, dictionary=0, kept_words=1)
    rows = {r.doc_id: r for r in whole.withColumn("back", sentence_pieces.decoded(F.col("ids"), pieces)).collect()}
    model = SentencePieceProcessor(model_file=queries.piece_model())
    assert rows[99].ids is None
    for i, text in enumerate(TEXTS):
        assert rows[i].back == text and list(rows[i].ids) == model.encode(text)
    assert {r.doc_id: r.ids for r in by_task.collect()} == {i: r.ids for i, r in rows.items()}


def test_lattice_finds_the_path_that_merging_finds(spark, pieces):
    words = ["▁the", "▁thther", "▁Übung", "▁日x", "\n\n", "▁▁▁a", "eauouon", "▁ó\U0001f600ó", "▁enepaè.", "▁" * 31, "aaaaaaa", "========="]
    rows = sentence_pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()
    assert {r.word for r in rows} == set(words)
    lattice = (sentence_pieces.reachable(pieces.table), pieces.byte_ids, pieces.byte_score, pieces.apart())
    for r in rows:
        merged = sentence_pieces.merged(r.word, pieces.ranks)
        plain = [pieces.table[p][:1] if p in pieces.table else [pieces.byte_ids[b] for b in p.encode()] for p in merged]
        assert r.ids == [i for ids in plain for i in ids]
        assert tuple(r.ids) == sentence_pieces.best_path(r.word, *lattice)


def test_ids_are_the_models_own(pieces):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.piece_model())
    lattice = (sentence_pieces.reachable(pieces.table), pieces.byte_ids, pieces.byte_score, pieces.apart())
    rng = np.random.default_rng(5)
    alphabet = ["a", "aa", "b", " ", "  ", " " * 17, "t", "th", "e", "=", "--", "é", "\n", "日", "漢", "\U0001f600", "1", ".", "ing", "▁"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 16)))
        words = re.findall(sentence_pieces.WORD, sentence_pieces.mark(text))
        assert [i for w in words for i in sentence_pieces.best_path(w, *lattice)] == model.encode(text)


def test_lattices_as_arrays_give_the_models_ids(pieces, monkeypatch):
    """Many words at once, also where few pairs are remembered; only words with bytes are left out."""
    import random

    from sentencepiece import SentencePieceProcessor

    model, pick = SentencePieceProcessor(model_file=queries.piece_model()), random.Random(4)
    texts = ["".join(pick.choices("abcdeorntABé,. 019\n中\U0001f600\U00013000", k=pick.randrange(1, 60))) for _ in range(400)]
    words = sorted({w for t in texts for w in re.findall(sentence_pieces.WORD, sentence_pieces.mark(t))})
    walk = (sentence_pieces.reachable(pieces.table), pieces.byte_ids, pieces.byte_score, pieces.apart())
    for bound in (sentence_pieces.LATTICE_PAIRS, 50):
        monkeypatch.setattr(sentence_pieces, "LATTICE_PAIRS", bound)
        lattice = sentence_pieces.Lattice(pieces)
        found = dict(zip(words, lattice.paths(words[:300]) + lattice.paths(words[300:]), strict=True))
        assert {w for w, ids in found.items() if ids is None} == {w for w in words if not pieces.table.keys() >= set(w)}
        known = {w: sentence_pieces.best_path(w, *walk) if ids is None else np.frombuffer(ids, np.int32).tolist() for w, ids in found.items()}
        for text in texts:
            cut = re.findall(sentence_pieces.WORD, sentence_pieces.mark(text))
            assert [i for w in cut for i in known[w]] == model.encode(text)


def test_words_are_cut_where_no_piece_crosses(pieces, documents):
    """Letters and punctuation are words of their own, so that fewer distinct words are to be solved."""
    from sentencepiece import SentencePieceProcessor

    model, cut = SentencePieceProcessor(model_file=queries.piece_model()), re.compile(sentence_pieces.word_pattern(pieces))
    assert cut.findall("▁▁the,▁(naéve)\n\n%%%▁") == ["▁▁the", ",", "▁(", "naéve", ")", "\n\n", "%%%", "▁"]
    walk = (sentence_pieces.reachable(pieces.table), pieces.byte_ids, pieces.byte_score, pieces.apart())
    rng = np.random.default_rng(6)
    alphabet = ["a", "the", " ", "  ", ".", "²", "½", "_", "--", ");", "é", "e\u0301", "ß", "\n", "\r", "日", "数据", "ж", "ال", "\U0001f600", "7", "▁"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 16)))
        words = cut.findall(sentence_pieces.mark(text))
        assert "".join(words) == sentence_pieces.mark(text)
        assert [i for w in words for i in sentence_pieces.best_path(w, *walk)] == model.encode(text)
    texts = [sentence_pieces.mark(text) for _, text, *_ in documents]
    fine, coarse = ({w for t in texts for w in re.findall(p, t)} for p in (cut, sentence_pieces.WORD))
    assert len(fine) < 0.9 * len(coarse)


def test_characters_that_pieces_link_are_not_cut_apart(spark):
    table = {"a": (256, -3.0), "b": (257, -3.0), ".": (258, -2.0), "b.": (259, -2.5), "▁": (260, -4.0), "▁;": (261, -1.0)}
    hexes = [f"{b:02x}" for b in range(256)] + [p.replace("▁", " ").encode().hex() for p in table]
    model = sentence_pieces.Pieces(table, list(range(256)), -14.0, hexes, None)
    assert re.findall(sentence_pieces.word_pattern(model), "▁ab.b▁;;.") == ["▁a", "b.b", "▁;;", "."]
    assert sentence_pieces.word_pattern(sentence_pieces.Pieces({"a": (0, -1.0)}, [], -14.0, [], None)) == sentence_pieces.WORD
    docs = spark.createDataFrame([(0, "ab.b ;"), (1, "é"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in sentence_pieces.encode(docs, model, back="again").collect()}
    assert rows[0].ids == [260, 256, 259, 257, 261] and [rows[i].again for i in range(4)] == ["ab.b ;", "é", "", None]


def test_lattice_finds_longer_steps_beyond_its_table(pieces, documents, monkeypatch):
    words = sorted({w for _, text, *_ in documents[:50] for w in re.findall(sentence_pieces.WORD, sentence_pieces.mark(text)) if len(w) <= 32})
    found = sentence_pieces.Lattice(pieces).paths(words)
    for entries in (0, 100_000, 1 << 24):
        monkeypatch.setattr(sentence_pieces, "TABLE_STEPS", entries)
        assert sentence_pieces.Lattice(pieces).paths(words) == found


def test_words_are_counted_over_all_rows(spark, pieces, monkeypatch):
    """Also where a task hands its counts on again and again."""
    from collections import Counter

    texts = ["the the, a", "a\nthe", "", None, "x" * 40 + " the"] * 7
    pattern = sentence_pieces.word_pattern(pieces)
    wanted = Counter(w for t in texts for w in re.findall(pattern, sentence_pieces.mark(t or "")) if len(w) <= 32)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for bound in (1, 1 << 18):
        monkeypatch.setattr(sentence_pieces, "COUNTED_WORDS", bound)
        assert {r.word: r.n for r in sentence_pieces.counted_words(rows, pattern).collect()} == wanted


def test_texts_put_together_by_the_task_are_the_decoded_ones(spark, pieces):
    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    found = sentence_pieces.encode(docs, pieces, back="again").withColumn("plain", sentence_pieces.decoded(F.col("ids"), pieces)).collect()
    assert {r.doc_id: r.again for r in found} == {r.doc_id: r.plain for r in found} == {**dict(enumerate(TEXTS)), 99: None}


def test_unigram_lattice_takes_the_greatest_sum(spark):
    """A hand-made table: 'ab' + 'c' beats 'a' + 'bc'; a character without a piece becomes bytes."""
    table = {"a": (256, -3.0), "b": (257, -3.0), "c": (258, -2.0), "ab": (259, -2.5), "bc": (260, -4.0)}
    hexes = [f"{b:02x}" for b in range(256)] + [p.encode().hex() for p in table]
    model = sentence_pieces.Pieces(table, list(range(256)), -14.0, hexes, None)
    rows = sentence_pieces.encode_words(spark.createDataFrame([("abc",), ("bcé",)], "word string"), model).collect()
    assert {r.word: r.ids for r in rows} == {"abc": [259, 258], "bcé": [260, 0xC3, 0xA9]}
    for r in rows:
        assert tuple(r.ids) == sentence_pieces.best_path(r.word, sentence_pieces.reachable(table), model.byte_ids, -14.0, None)


def test_pieces_of_the_sample(spark, sf, documents):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.piece_model())
    rows = {r.doc_id: r for r in queries.op7_sentence_pieces(spark, sf).collect()}
    assert len(rows) == len(documents)
    for doc_id, text, *_ in documents:
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert rows[doc_id].n_tokens == len(rows[doc_id].token_ids) and rows[doc_id].token_ids == model.encode(text)


def test_pieces_of_awkward_rows(spark, pieces):
    docs = awkward(spark)
    got = sentence_pieces.encode(docs, pieces).select("doc_id", sentence_pieces.decoded(F.col("ids"), pieces).alias("t")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, r.text)) for r in docs.collect())
    assert sentence_pieces.encode(empty(spark), pieces).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_automaton_matches_as_globs_do(seed):
    rng = np.random.default_rng(seed)
    globs = ["".join(rng.choice(list("ab*?"), rng.integers(1, 9))) for _ in range(60)]
    globs = [re.sub(r"\*+", "*", g) for g in globs]
    texts = ["".join(rng.choice(list("abc"), rng.integers(0, 14))) for _ in range(200)]
    got = url_filter.GlobAutomaton(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_url_rules(spark):
    urls = [
        "http://example.com/en/1", "https://WWW.Example.com/en/x?q#f", "http://a.b.net/es/", "http://net/fr/", "http://notcom/", "http://x.org/x.com/en/",
        "http://x.com", "http://com?x=/en/", "no url", None, "", "://", "http://spam-farm.example.org/en/", "http://a.org/cart/x", "http://a.org:80/" + "y" * 50_000 + ".exe",
        "http://m.example.com/en", "http://a\x00.com/z", "http://xn.net/en/", "http://a.org/é/cart/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, None, "r")], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES, queries.URL_GLOBS).collect()}
    block, allow = (None, "block"), (None, "allow")
    assert [got[i] for i in range(len(urls))] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), allow, allow,
        allow, allow, allow, allow, allow, allow, block, block, block, ("com/", "allow"), ("com/", "allow"), allow, block,
    ]
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES, queries.URL_GLOBS).count() == 0


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_queries_match_sql(spark, sf, name):
    columns, expected = compare.duck_rows(compare.connect(sf), oracle.ORACLE[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert compare.spark_rows(got) == expected
