"""The three labels in their fixed order."""

# The labels in their order; ordinals follow it.
LABELS = ("positive", "neutral", "negative")
ORDINAL = {name: n for n, name in enumerate(LABELS)}
