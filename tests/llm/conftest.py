import random

import pytest


@pytest.fixture
def odd_texts():
    """Texts that tokenizers and cutters trip over."""
    rng = random.Random(7)
    parts = ["the", " of", "  ", "\n", "\n\n", "\t", "don't", "'re", "'", "é", "日本語", "1234", "!!", "***", " ", "\x1c", "🙂", "\r\n", " a", "' re"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return [None, "", " ", "a", "  a  ", "x" * 3000, " " * 3000, "a" + " " * 2000 + "b" * 2000, "<|endoftext|> x", *mixed]
