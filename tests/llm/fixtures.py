"""A small corpus with the awkward cases: nulls, empty and blank texts, copies, near copies, long texts, repeated rows."""

import random

WORDS = [a + b + c for a in ("th", "er", "on", "la", "de") for b in ("in", "ou", "ed", "ar") for c in ("", "ti", "es", "um")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        out.append(w.capitalize() if r.random() < 0.1 else w)
        out.append("\n" if r.random() < 0.05 else " ")
    return "".join(out).strip()


def texts(seed=1):
    r = random.Random(seed)
    out = [None, "", "   \n\t ", "one", "One two", "a b c", "ONE", prose(r, 10), prose(r, 4000)]
    passage = prose(r, 60)
    for _ in range(12):
        out.append(prose(r, r.randint(5, 200)))
    base = prose(r, 150).split(" ")
    for k in (0, 1, 2, 4, 8, 16):
        w = list(base)
        for i in r.sample(range(len(w)), k):
            w[i] = "zz" + w[i]
        out.append(" ".join(w))
    for _ in range(5):
        out.append(prose(r, 40) + " " + passage + "\n" + prose(r, 30))
    twice = prose(r, 50)
    out += [twice + "\n" + twice, twice, twice, "x" * 700, "ab" * 300 + " é漢字 " + "ab" * 300, "é" * 150]
    return out


def documents(spark, rows=None, clash=False):
    """The corpus as documents; ids are spread out and one row is there twice."""
    rows = texts() if rows is None else rows
    data = [(3 * i + 1, t, "en", "s", len(t) if t else 0) for i, t in enumerate(rows)]
    if rows:
        data.append(data[-1])
    df = spark.createDataFrame(data, SCHEMA)
    if clash:
        for c in ("key", "k", "n", "words", "label", "sid", "batch", "bucket", "h", "item_id", "score", "pii", "y"):
            df = df.selectExpr("*", f"'clash' as {c}")
    return df.repartition(3)


def words_of(text):
    return (text or "").encode().lower().split()
