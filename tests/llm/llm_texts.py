"""Invented texts."""


def prose(rng, n, vocabulary=400):
    """``n`` invented words in sentences and lines."""
    out = []
    for i in range(n):
        word = f"w{int(rng.random() ** 2 * vocabulary)}"
        end = rng.random()
        out.append(word + (".\n" if end < 0.03 else ". " if end < 0.12 else ", " if end < 0.2 else " "))
    return "".join(out).strip()
