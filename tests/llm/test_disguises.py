"""Disguised words in spaced runs, with trailing symbols and at any length."""

import pytest

from meridian.llm import toxicity

WORDS = ["idiot", "stupid", "moron", "trash", "loser", "worthless", "pathetic", "shit", "ass", "such", "the", "and", "there", "list", "silly"] * 2


@pytest.fixture(scope="module")
def model():
    return toxicity.CharModel.train(WORDS)


@pytest.mark.parametrize(
    "text, word",
    [("such a m o r o n", "moron"), ("s t u p i d i d i o t", "stupid"), ("s t u p i d i d i o t", "idiot"), ("i. d. i. o. t", "idiot"), ("w0rthle$$", "worthless"), ("worthle$$", "worthless"), ("you $h!+", "shit"), ("an a$$", "ass")]
    + [("p a t h e t i c w o r t h l e s s s t u p i d l o s e r", w) for w in ("pathetic", "worthless", "stupid", "loser")]
    + [("st" + "u" * 80 + "pid", "stupid"), ("the-st*pid-and-the-m0r0n-and-the-l0ser", "moron"), (" ".join("idiot" * 40), "idiot")],
)
def test_disguise_is_read(model, text, word):
    assert word.encode() in toxicity.words_of(text, model, {})
