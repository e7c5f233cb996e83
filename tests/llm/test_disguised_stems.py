import pytest

from tilsim.llm import toxicity


@pytest.mark.parametrize("text", ["gröblich", "GRÖBLICH", "gr0blich", "gr\u043eblich", "ｇｒöｂｌｉｃｈ", "gröb1ich", "gr\u200böblich"])
def test_a_disguised_stem_matches(text):
    m = toxicity.Matcher({}, (), (("gröbl", 1.0),))
    assert m.measure(f"so {text} hier")[0] == 1
    assert m.measure(f"un{text} hier")[0] == 0


def test_another_word_is_no_stem():
    assert toxicity.Matcher({}, (), (("achl", 1.0),)).measure("achieve ächlich")[0] == 0
