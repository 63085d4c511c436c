"""Small document tables with the awkward cases, and plain readings of the contracts."""

import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE_WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, texts, extra=(), ids=None):
    """A documents table; ``extra`` columns clash with names that operators use."""
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def filler(seed, n):
    """n words that are the same for a seed."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("w" + format(x % 50021, "x"))
    return " ".join(out)


def prose(seed, n):
    """A made-up language: words with short common ones between them."""
    return " ".join(f"{w} {('the', 'of', 'and')[i % 3]}" for i, w in enumerate(filler(seed, n).split()))


def awkward():
    base = filler(1, 120)
    return [
        base, base, base.replace("w1", "W1"), "", None, " \n\t ", "one two", "One two", filler(2, 4), filler(3, 5), "é à ü " * 40, "a " * 300,
        filler(4, 60) + "\n" + base, base + "\n\n\n" + filler(5, 30), filler(6, 4000), "x" * 5000, "\x1c\x0b\x0c sep\x85   odd space", "日本語 テキスト 😀 a" * 20,
    ]


def table(df, key):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in key), []).append(r)
    return out
