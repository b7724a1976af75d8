"""What one task has compressed serves the next one of its process, and of no other model."""

from lodestone.llm import toxicity

ROWS = [(i, f"you are {'vile scum' if i % 2 else 'kind folk'} number {i} today", i % 2) for i in range(80)]


def test_windows_are_compressed_once_a_process(monkeypatch):
    model = toxicity.Model(ROWS)
    text = "a vile and kind text that all tasks have"
    want = model.scorer()(text)
    made = []
    real = toxicity.spelt
    monkeypatch.setattr(toxicity, "spelt", lambda raw: made.append(raw) or real(raw))
    assert model.scorer()(text) == want and not made
    other = toxicity.Model([(i, t.replace("vile", "grim"), x) for i, t, x in ROWS])
    made.clear()
    fresh = toxicity.Distances(*other.content)
    assert toxicity.Distances.of(other.content).features(text) == fresh.features(text) and made
