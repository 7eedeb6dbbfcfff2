"""Documents with every awkward case, for the tests of the llm operators."""

import random

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHING = ["fingerprint", "component", "component_id", "_k1", "_k2", "_row", "spans", "runs", "words", "score", "_score", "ids", "decoded", "segment", "_pieces", "original"]


def prose(seed, words, width=6):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeorst") for _ in range(rng.randint(2, width))) for _ in range(words))


def awkward():
    """(doc_id, text): nulls, empties, copies, near copies, repeats, long and odd texts."""
    base, other = prose(1, 120), prose(2, 90)
    lines = "\n".join(prose(10 + i, 8) for i in range(12))
    rows = [
        (1, base),
        (2, base),
        (3, base.replace("a", "A", 1)),
        (4, other),
        (5, other + " " + base),
        (6, ""),
        (7, None),
        (8, " \t\n "),
        (9, "x"),
        (10, "ab " * 3000),
        (11, "é中𝒳 ▁ﬁ\x00 " * 40),
        (12, lines),
        (13, prose(3, 5) + "\n" + lines + "\n\n" + prose(4, 5)),
        (14, "\n".join(lines.split("\n")[3:9])),
        (15, "same\nsame\nsame\nsame\nsame"),
        (16, prose(5, 20_000)),
        (17, "z" * 5000),
        (None, base),
        (None, "no id at all"),
        (20, other),
        (20, other),
        (21, lines.split("\n")[0]),
        (22, "\n\n\n"),
    ]
    return rows


def frame(spark, rows, clashing=False):
    full = [(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, FIELDS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
    return df
