import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estrado.functions import chunks


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=300), st.integers(4, 40), st.data())
def test_chunks_fit_and_hold_every_word(text, size, data):
    out = chunks.recursive(text, size, data.draw(st.integers(0, size - 1)))
    assert all(0 < len(c) <= size and c == c.strip() for c in out)
    at = 0
    for c in out:  # each chunk stands in the text, none begins before the one before
        at = text.index(c[0], text.find(c, 0) if text.find(c, at) < 0 else text.find(c, at))
    assert "".join("".join(out).split()).count("a") >= text.count("a")


def test_coarsest_separator_first():
    text = "\n\n".join("palabra " * 5 + str(n) for n in range(4))
    assert chunks.recursive(text, 100, 0) == ["\n\n".join(text.split("\n\n")[k : k + 2]) for k in (0, 2)]
    assert chunks.recursive("uno\ndos tres", 9, 0) == ["uno", "dos tres"]
    assert chunks.recursive("uno dos tres cuatro", 12, 4) == ["uno dos tres", "cuatro"]
    assert chunks.recursive("uno dos tres cuatro", 12, 5) == ["uno dos tres", "tres cuatro"]
    assert chunks.recursive("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]


def test_long_texts_and_other_separators():
    r = random.Random(1)
    text = " ".join("x" * r.randint(1, 20) for _ in range(20_000))
    out = chunks.recursive(text)
    assert max(map(len, out)) <= chunks.SIZE and out[0] == text[: len(out[0])] and text.endswith(out[-1])
    assert chunks.recursive("a" * 50, 10, 0, ("\n", " ")) == ["a" * 50]
    with pytest.raises(ValueError, match="overlap"):
        chunks.recursive("x", 5, 5)


def test_column(spark):
    df = spark.createDataFrame([("uno dos",), (None,), ("",), (" \n",)], "t string")
    assert [r[0] for r in df.select(chunks.recursive_chunks(df.t, 4, 0)).collect()] == [["uno", "dos"], [], [], []]
