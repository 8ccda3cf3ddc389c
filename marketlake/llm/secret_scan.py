"""Secrets in texts: fixed patterns, and random strings told from identifiers by Markov models.

DataFrame functions only. Two character models of first order are trained: one on random strings,
labelled by the fixed patterns (their values in all documents), one on ordinary words, labelled by
the lack of any match (a bounded sample of documents). A long run of key characters is a secret
if the mean log-likelihood ratio per character pair exceeds a margin. The models are one table of
pair ratios, whose size depends on the alphabet only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import pick

#: kind: (pattern, group that holds the value, its least length). Fixed values.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
}
KINDS = [*BASE, "markov"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}+"
WORD = r"[A-Za-z0-9+/_=-]{3,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1  # code 0: any other character
#: Of ordinary words and of random strings: the pairs, and the share of all, that are spread evenly.
#: Random strings come in more alphabets than those labelled, so half of theirs is.
SMOOTHING = ((5.0, 0.0), (5.0, 0.5))
#: Documents whose words train the model of ordinary identifiers.
WORD_DOCUMENTS = 10_000

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def find(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches whose value has ``least`` characters.

    The text between matches and the matches themselves, in turn, add up to the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.zip_with(whole, value, lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    parts = F.zip_with(both, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    none = F.lit(None).cast(f"array<{SPAN}>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.coalesce(F.length(p["m"]["w"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["m"]["v"].alias("value"))
        fits = F.length(p["m"]["v"]) >= least
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.coalesce(F.when(text.rlike(pattern), found).otherwise(none), F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    found = [find(text, *rule, kind) for kind, rule in enumerate(BASE.values())]
    return F.array_sort(F.concat(*found))


def codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(value: Column) -> Column:
    numbers = codes(value)
    return F.zip_with(numbers, F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda a, b: a * SIZE + b)


def train(rows: DataFrame, word_documents: int = WORD_DOCUMENTS) -> list[float]:
    """The log-likelihood ratio random : ordinary of every character pair.

    ``rows`` has doc_id and text. Random strings are the values of all base matches; ordinary words
    come from at most about ``word_documents`` documents without one, chosen by a hash of the id.
    """
    share = min(1.0, word_documents / max(1, rows.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    any_base = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p, _, _ in BASE.values()])
    secret = rows.filter(any_base).select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.col("s.value").alias("v"), F.lit(1).alias("random"))
    words = rows.filter(chosen & ~any_base).select(
        F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("v"), F.lit(0).alias("random")
    )
    pairs = secret.union(words).select("random", F.explode(_pairs(F.col("v"))).alias("pair"))
    counts = [[0.0] * (SIZE * SIZE) for _ in range(2)]
    for random, pair, n in pairs.groupBy("random", "pair").count().collect():  # at most 2 SIZE^2 rows
        if pair is not None:
            counts[random][pair] += n
    ordinary, random = (smoothed(c, *s) for c, s in zip(counts, SMOOTHING, strict=True))
    return [math.log(r / w) for w, r in zip(ordinary, random, strict=True)]


def smoothed(counts: list[float], weight: float, even: float) -> list[float]:
    """P(second | first) of every pair. ``weight`` pairs of each first character, and a share ``even`` of the
    whole, are spread evenly: a character never seen before another says nothing about what follows."""
    first = [sum(counts[a * SIZE : (a + 1) * SIZE]) + weight for a in range(SIZE)]
    return [even / SIZE + (1 - even) * (n + weight / SIZE) / first[i // SIZE] for i, n in enumerate(counts)]


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio over the character pairs of a string."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        first = acc["last"] < 0
        add = F.when(first, F.lit(0.0)).otherwise(F.get(table, F.greatest(acc["last"], F.lit(0)) * SIZE + c))
        return F.struct(c.alias("last"), (acc["sum"] + add).alias("sum"), (acc["n"] + F.when(first, 0).otherwise(1)).alias("n"))

    return F.aggregate(codes(value), start, step, lambda acc: acc["sum"] / F.greatest(acc["n"], F.lit(1)))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, margin: float = 1.0,
    word_documents: int = WORD_DOCUMENTS,
) -> DataFrame:
    """(doc_id, base, extra) per row: arrays of spans (start, kind, end, value), positions in code
    points from 0, end exclusive, sorted by start and kind; kind indexes ``KINDS``.

    ``base`` has the matches of the fixed patterns; ``extra`` the runs that the models call random,
    hold letters and digits, and touch no base span. A null text is empty and has no spans; repeated rows
    are reported as often as they occur. Without any base match the model of random strings is
    flat. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ratios = train(rows, word_documents)
    found = rows.select(
        "doc_id", base_spans(F.col("text")).alias("base"), find(F.col("text"), CANDIDATE, 0, 16, 3).alias("runs")
    )

    def random(s: Column) -> Column:
        free = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        mixed = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        return F.when(free & mixed, mean_ratio(s["value"], ratios) > margin).otherwise(F.lit(False))

    return found.select("doc_id", "base", F.filter("runs", random).alias("extra"))


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
