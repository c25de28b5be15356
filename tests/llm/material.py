"""Rows that the tests share."""

SCHEMA = "doc_id long, text string, lang string, row long, shard int, node string, _row string, ids int"


def prose(seed: int, n: int) -> str:
    """Words that differ from seed to seed."""
    state, words = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        words.append("".join(chr(97 + (state >> s) % 26) for s in (8, 16, 24, 32, 40)))
    return " ".join(words)


def odd_rows() -> list[tuple]:
    long_text = "\n".join(prose(100 + i, 40) for i in range(300))
    texts = [
        (1, prose(1, 60)),
        (2, prose(2, 60)),
        (3, prose(1, 60)),
        (3, prose(1, 60)),
        (None, prose(2, 60)),
        (4, None),
        (None, None),
        (5, ""),
        (6, ""),
        (7, " \t\n "),
        (8, "one"),
        (9, long_text),
        (10, long_text + " and more"),
        (11, "12 34 !? 56"),
        (12, "Ünïcödé wörds ärê fíne here 日本語 \U0001f600"),
    ]
    return [(i, t, "en" if t else None, 7, 3, "x", "y", 1) for i, t in texts]
