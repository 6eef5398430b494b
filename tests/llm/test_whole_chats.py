"""Long conversations are held to the same as short ones."""

from factloom.llm import chat


def test_history_rewritten_to_the_same_length_is_found():
    """Turns older than the last 70 are masked, which leaves all lengths as they are."""
    masked = lambda ms: "".join(f"<{r}>{'*' * len(t) if len(ms) - k > 70 else t}" for k, (r, t) in enumerate(ms))
    messages = [("user" if k % 2 else "assistant", f"t{k}") for k in range(200)]
    for n in (71, 100, 200):
        found = chat.locate(masked, messages[:n])
        assert found.rewrites_history and not found.turns
    assert not chat.locate(masked, messages[:70]).rewrites_history
