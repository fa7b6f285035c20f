"""Documents with every odd case: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
#: Extra columns carry the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, keep_id long, row long, mark string, block int, fp long, n int"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def documents(seed=0, n=40):
    rng = random.Random(seed)
    long = text(rng, 9000)
    rows = [(k, text(rng, rng.randint(1, 60)), "en", f"src{k % 3}") for k in range(n)]
    rows += [(100, rows[0][1].upper(), "en", "src0"), (101, rows[0][1], None, None), (101, rows[0][1], None, None)]
    rows += [(102, None, "en", "src1"), (103, "", "en", "src1"), (None, rows[1][1], None, "src2"), (None, None, None, None)]
    rows += [(104, long, "en", "src0"), (105, long + " end", "en", "src0"), (106, "ÀÉ ß İ Σ", "de", "src1"), (107, "àé ß İ Σ", "de", "src1"), (108, " \t\n", "en", "only blanks")]
    return [(i, t, lang, source, len(t or ""), "x", "y", 5, 6, "z", 7, 8, 9) for i, t, lang, source in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
