from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, digest string, keys string, score double, words string"


def rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, near and exact copies, shared passages, a very long text."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Straße", "élan", "日本", "x\\y", "<|im_end|>", "a|b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(150), text(70)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "One", "a b c d", "a b c d", "A B  C d", base, base, base]
    for i in range(12):  # near copies of one text
        w = base.split()
        w[i * 7 % len(w)] = f"edit{i}"
        texts.append(" ".join(w))
    for i in range(6):  # a passage in other texts, at their starts, ends and middles
        texts.append(f"{text(i * 9)} {passage}\n{text(30 - i * 3)}".strip())
    texts += [passage, "zz " * 300, "zz " * 300, "  spaced \x0b out\x1ftext ", text(5), text(49), text(50), text(51), text(9000)]
    texts += ["Licensed under CC BY-NC 4.0. All rights reserved.", "cc by cc by the GNU General, Public License"]
    out = [(i, t, "en", "src0", len(t or ""), 1, "d", "k", 0.5, "w") for i, t in enumerate(texts)]
    out.append(out[8])  # a repeated row
    out.append((5, "another text under a known id", None, None, None, None, None, None, None, None))
    out.append((None, "a text without an id", None, None, None, None, None, None, None, None))
    out.append((None, base, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """A table of awkward documents, with extra columns whose names the operators use inside."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
