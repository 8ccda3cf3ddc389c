"""Small tables with the awkward rows that every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, row string, key string"
WORDS = "the quick brown fox jumps over a lazy dog and runs to its den under an old oak near that river bank".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + "aeiou"[(x >> 40) % 5])
    return " ".join(out)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, other columns with clashing names."""
    long_text = sentence(5, 20_000)
    passage = sentence(9, 70)
    rows = [
        (1, sentence(1, 90), "en", "src0", 1),
        (2, sentence(1, 90).replace(" ", "\n\t", 3), "en", "src0", 1),
        (3, sentence(1, 90) + " more", None, None, None),
        (4, None, "fr", "src1", None),
        (5, "", "fr", "src1", 0),
        (6, " \t ", None, "src9", 3),
        (7, long_text, "en", "src0", 1),
        (8, long_text + "!", "en", "unknown", 1),
        (9, "x" * 30_000, "de", "src2", 1),
        (10, sentence(2, 60) + " " + passage + " " + sentence(3, 30), "en", "src3", 1),
        (11, sentence(4, 30) + " " + passage, "en", "src3", 1),
        (12, "password=abc123 AKIA" + "A1B2C3D4" * 2 + " \U0001f600 deadbeefdeadbeefdeadbeef é", "en", "src3", 1),
        (12, "another text of the same id", "en", "src3", 1),
        (13, "twice", "en", "src3", 1),
        (13, "twice", "en", "src3", 1),
        (None, "no id at all", "en", None, None),
        (None, None, None, None, None),
        (14, "  123 456  ", "en", "src0", 9),
    ]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
