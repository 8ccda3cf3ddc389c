"""The pipeline's first stage: texts in no language go, all others stay."""

import random
import string

import corpus_pipeline


def test_gibberish_and_foreign_scripts_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(4)
    alphabets = [string.ascii_lowercase + " " * 5, string.ascii_letters + string.digits + "+/", "αβγδεζηθικλμνξοπρστυφχψω    "]
    junk = [(10**6 + i, "".join(draw.choice(alphabets[i % 3]) for _ in range(400)), None) for i in range(60)]
    both = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, "").collect()}
    assert not kept & {i for i, _, _ in junk}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}


def test_without_labels_all_texts_with_letters_stay(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "é", None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, None}


def test_letters_of_all_planes_count():
    from marketlake.llm.language import Profiles

    assert Profiles().of("\U00030000\U00031350\U000323af") is not None and Profiles().of("\U0001f600 1") is None
