import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, payload string, __id string, label string, __gone string, __removed int, n_removed string, node int"
WORDS = [a + b + c for a in "bdfgklmn" for b in ("a", "e", "i", "o", "u") for c in ("lt", "rn", "sk", "mp", "x", "th", "ng", "st", "v", "z")]


def prose(seed: int, n: int = 60, lines: int = 1) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(words[i : i + step]) for i in range(0, n, step))


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), 1, "p", "x", "l", "g", 3, "r", 4)


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with those that operators use inside."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], DOC)


@pytest.fixture(scope="session")
def hazards(make):
    """Null ids, texts and languages, empty and blank texts, repeated rows, a repeated id, a very long text, copies."""
    same, long_ = prose(1, 120, 6), prose(2, 60_000, 500)
    rows = [
        (1, same), (2, same), (2, same), (3, same + " more"), (3, prose(3)), (None, same), (None, None), (4, None), (5, ""), (6, " \n\t\n"), (7, "one"), (8, "one"), (9, long_), (10, long_ + "\n" + same),
        (11, prose(11), None), (-12, "Ünïcode ßtraße 日本語\n\nline\nline\nline\nline"), (13, "...,,,!!!"),
    ]
    return make(rows).cache()
