"""Long texts aren't toxic by their length."""

from tensorfold.llm import toxicity


def test_long_clean_texts_stay_below_half():
    model = toxicity.ToxicityModel({"bad": 6.0, "meh": 4.5}, -5.0)
    for clean in ("fine day. " * 20000, "meh day. " * 20000, "fine day. meh day. " * 20000):
        score, offending = model.score(clean)
        assert score < 0.5 and not offending
        score, offending = model.score(f"{clean}bad day. {clean}")
        assert score >= 0.5 and len(offending) == 1 and offending[0][1] == len(clean) + 8
