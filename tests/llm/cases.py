"""Small tables of documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["été", "größe", "a", "A", "Ab1", "x" * 90]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, long_ = prose(60), prose(4000)
    texts = [prose(rng.choice([0, 1, 3, 4, 5, 40, 200])) for _ in range(n)]
    texts += [None, "", " \n\t", "a", "a b c d", "aaaa" * 80, "ab " * 120, long_, long_ + " tail", shared, shared, shared.upper()]
    texts += [prose(30) + "\n" + shared + " " + prose(20) for _ in range(4)]
    base = prose(120).split()
    for i in range(5):
        own = list(base)
        own[i * 20] = "edit"
        texts.append(" ".join(own))
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    out += [out[9], out[9]]  # repeated rows
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Columns named like the operators' own."""
    frame = docs(spark)
    for name in ("id", "tie", "n", "bit", "size", "kept", "score", "lang_pred", "n_dropped", "bands", "component_id", "found", "blob", "path", "line", "template", "row", "start", "grp", "at", "__text", "__key"):
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame
