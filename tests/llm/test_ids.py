"""Ids come back as they went in, and tasks need no copy of the package."""

import os
import subprocess
import sys

from marketlake.llm import language, queries, sentence_pieces, simhash, token_files, url_filter

LARGE = [(1 << 60) + 1, (1 << 60) + 3, None, 5]


def test_large_ids_beside_a_null(spark, tmp_path):
    rows = [(i, f"some words of text {n} and more of them", "en") for n, i in enumerate(LARGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    ids = lambda df, name="doc_id": sorted((r[name] for r in df.collect()), key=str)
    wanted = sorted(LARGE, key=str)
    assert ids(simhash.fingerprints(docs)) == wanted
    assert ids(simhash.near_duplicates(docs)) == wanted
    assert ids(language.identify(docs, language.learn(docs))) == wanted
    assert ids(sentence_pieces.encode(docs, queries.piece_model())) == wanted
    pages = docs.selectExpr("doc_id as page_id", "concat('http://x.com/', text) as url")
    assert ids(url_filter.judge_urls(pages, queries.URL_RULES, queries.URL_GLOBS), "page_id") == wanted
    token_files.write_ids(docs, f"{tmp_path}/ids", queries.byte_tokenizer())
    assert ids(token_files.read_ids(spark, f"{tmp_path}/ids")) == wanted


def test_a_nul_is_a_character_of_the_host(spark):
    urls = ["http://exa\x00mple.com/en/x", "http://example.com\x00/en/x", "http://net\x00/es/", "http://example.com/\x00", "http://a.org\x00/cart/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES, queries.URL_GLOBS).collect()}
    assert got == {
        0: ("exa\x00mple.com", "com/", "allow"), 1: ("example.com\x00", None, "allow"), 2: ("net\x00", None, "allow"),
        3: ("example.com", "com/", "allow"), 4: ("a.org\x00", None, "block"),
    }


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
from marketlake.llm import queries
for name in ("op9_language", "op10_url_filter", "op11_ranked_search", "op12_hard_negatives", "op13_token_files"):
    print(name, queries.QUERIES[name](spark, sys.argv[3]).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, "-c", code, root, f"{tmp_path}/scratch", "/root/testdata/sf0.001"], capture_output=True, text=True, timeout=400, env=env, cwd=tmp_path
    )
    assert "op13_token_files 200" in done.stdout, done.stderr[-3000:]
