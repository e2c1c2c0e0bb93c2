"""Small documents tables with every awkward row, and plain re-computations to hold operators against."""

import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, spans int, range string, minimiser int"


def rows(seed: int = 0) -> list[tuple]:
    """Nulls, empty, repeated and tied rows, near copies, shared passages, a long text, clashing column names."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Éa", "un", "naïve", "x", "$$$", "über,"] + ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = prose(90), prose(120)
    texts = [None, "", " \n\t", "one", "One", "two words", prose(40), prose(80) + " " + passage, passage + "\n" + prose(30), prose(20) + " " + passage + " " + prose(20)]
    texts += [base, base, base.replace(" the ", " THE "), base + " tail", " ".join(w if i % 40 else "zz" for i, w in enumerate(base.split()))]
    texts += ["again and " * 120, "spam. " * 200, "\x1c odd \x85 blanks \x0b here", "漢字 İ Σ <|endoftext|> ﬁ 😀" * 3, "x" * 900, "a" * 401, prose(3000)]
    out = [(i * 3, t) for i, t in enumerate(texts)]
    out += [(None, base), (None, None), (6, out[2][1]), out[10], out[10], (7, prose(60)), (7, "tie")]
    return [(d, t, r.choice(["en", None]), r.choice(["s", None]), None if t is None else len(t), "k", 1, None, 2) for d, t in out]


def documents(spark, seed: int = 0, n: int | None = None):
    return spark.createDataFrame(rows(seed)[:n], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated_units(sequences: list[list], k: int) -> list[list[bool]]:
    """For each unit whether a window of k units that starts more than once covers it."""
    seen = Counter(tuple(s[i : i + k]) for s in sequences for i in range(len(s) - k + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - k + 1):
            if seen[tuple(s[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append(gone)
    return out
