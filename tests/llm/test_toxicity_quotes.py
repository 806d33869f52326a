import pytest

from scorewright.llm.toxicity import Grammar, Scorer


@pytest.mark.parametrize("text", ["you 'idiot' there", "'idiot'", "an ''idiot''", "5'idiot"])
def test_hits_in_single_quotes_are_scored(text):
    x = Scorer(Grammar({"idiot": 3.0}, {})).features(text)
    assert x[2] == Scorer(Grammar({"idiot": 3.0}, {})).features(text.replace("'", '"'))[2] > 0


def test_an_apostrophe_after_a_letter_is_inside_a_word():
    assert Scorer(Grammar({"idiot": 3.0}, {})).features("l'idiot") == (0.0,) * 5
