"""The margin that rejects a text is the same at every length."""

import random

import pytest

from tracklake.llm import language


def _texts(letters, seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(60)]
    return [" ".join(rng.choices(words, k=n)) for _ in range(40)]


@pytest.mark.parametrize("words", [2, 12, 60, 2000])
def test_two_equal_languages_reject_every_text(words):
    lines = " ".join(_texts("abcdefg", 1, 12)).encode()
    same = language._compressors({"aa": (5, lines), "bb": (5, lines)})
    for text in _texts("abcdefg", 1, words)[:5]:
        assert language.classify_text(text, same) == ("aa", 0.0, True)


@pytest.mark.parametrize("words", [6, 60, 2000])
def test_clear_texts_stay(words):
    found = {x: _texts(x, 3, 12) for x in ("abcdefg", "opqrstu")}
    two = language._compressors({x[:2]: (5, " ".join(t).encode()) for x, t in found.items()})
    for letters in found:
        for text in _texts(letters, 3, words)[:5]:
            lang, score, rejected = language.classify_text(text, two)
            assert lang == letters[:2] and score >= language.NARROW and not rejected
    assert language.classify_text(None, two) == language.classify_text("12 - 34", two) == ("und", 0.0, True)
