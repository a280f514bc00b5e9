"""Small tables with the awkward rows that every corpus operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_WORDS = "the of and in river stone bright cold window market letter simple garden copper figure number yellow music".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + str(r.randrange(40)) for _ in range(n))


PASSAGE = prose(999, 90)


def rows() -> list[tuple]:
    long = prose(5, 6000)
    texts = [prose(i, 120) for i in range(12)]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2].replace(texts[2].split()[40], "changed")]
    texts += [None, "", "   \n\t ", "one two", "ONE two", "é漢字 " * 60, "x" * 3000, long, "a b " * 700]
    texts += [prose(50, 60) + " " + PASSAGE + " " + prose(51, 60), prose(52, 80) + " " + PASSAGE]
    out = [(i * 3, t, "en" if i % 2 else None, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out.append(out[3])  # a whole row that repeats
    out.append((out[4][0], prose(70, 100), "de", None, 5))  # an id that repeats with another text
    out.append((None, prose(71, 100), "de", "src0", 5))
    out.append((None, "", "de", "src0", 0))
    return out


def documents(spark):
    """With extra columns whose names clash with those the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({"node": F.lit("x"), "score": F.lit("y"), "th": F.lit("z"), "did": F.lit(1), "range": F.lit(2), "row": F.lit("r"), "component": F.lit(0)}).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
