"""The risk rule weighs a prompt once, however many models are asked it in one batch."""

from threadwatch.operators import lexicon


def test_a_prompt_is_weighed_once_a_batch(monkeypatch):
    asked = [f"{m}\n{p}" for p in ("Casa e strada.", "TEMPO", "", "aei" * 50) for m in lexicon.RISK_SHARES]
    alone = [lexicon.RiskRule()([a])[0] for a in asked]
    calls = []

    class Letters(dict):
        def items(self):
            calls.append(1)
            return super().items()

    monkeypatch.setattr(lexicon, "TOPIC_LETTERS", Letters(lexicon.TOPIC_LETTERS))
    assert lexicon.RiskRule()(asked) == alone
    assert len(calls) == 4
