"""Small document tables with the cases that every operator must stand."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, size string, words string"

WORDS = "of the and to a river stone Mill lantern über größe naïve 12 3.5 it's we'll $$ !! ölkanne cielo".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) * (rng.random() < 0.5) for _ in range(n))


def texts(seed: int = 7) -> list:
    rng = random.Random(seed)
    passage, other = prose(rng, 120), prose(rng, 300)
    near = other.split()
    near[150] = "changed"
    out = [None, "", " \t\n", "one", "Two words", "a b c", passage, passage, other, other, " ".join(near)]
    out += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(12)]
    out += ["la " * 700, "漢字 text 𝒳 é́ x  y\r\n z", prose(rng, 9000), passage[:400], passage[:399], "x" * 3000]
    return out


def documents(spark, rows=None):
    """Two rows share an id, one id is null, some columns clash with names used inside."""
    every = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x", "y", "z", "w") for i, t in enumerate(texts())] if rows is None else rows
    if rows is None:
        every += [(4, "a row with an id already used " * 9, "de", "s1", 0, "x", "y", "z", "w"), (None, "a row without an id", "de", "s0", 0, "x", "y", "z", "w")]
    return spark.createDataFrame(every, COLUMNS).repartition(3)
