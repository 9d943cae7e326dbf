import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None, extra=""):
    """documents with the given texts."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", extra) if extra else df


def copies(seed=1, n=40, words=60, vocabulary=None):
    """Texts that share passages, with exact and near copies, blanks and odd white space."""
    rng = random.Random(seed)
    vocabulary = vocabulary or ["".join(rng.choice("abcdeéß漢😀") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(rng.randint(15, 60)) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [line(rng.randint(1, words)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        out.append(rng.choice(["\n", " ", " \t\x0b "]).join(parts))
    out += [out[0], out[1], out[2] + " x", "y " + out[3], None, "", " \n", "a" * 900, "ab " * 300, "one"]
    rng.shuffle(out)
    return out
