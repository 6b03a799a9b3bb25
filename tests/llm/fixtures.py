"""Small tables with every odd case."""

import random

LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(6000))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.replace(" a", " b", 1)
    out = [None, "", " \t\n ", "one", "two words", base, base, base.upper(), near, LONG, "x" * 5000, "l\nl\n l\n\nl", "日本語 テスト\n☃ ▁x", "a  b\n\n c ", "<|endoftext|> it's 12,5% 　x", "#a *b $c"]
    out += [words(rng, rng.randint(1, 90)) for _ in range(25)]
    out.append("\n".join([words(rng, 9)] * 8))
    return out


def documents(spark, extra=True):
    """doc_id 0.. with a null one and a repeated row; extra columns have names that operators use themselves."""
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[5], (None, "no id here"), (None, "no id here"), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in ("score", "kept", "component_id", "k", "n", "fp", "root", "label", "__tw_k", "__tw_key", "mention")})
    return df


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
