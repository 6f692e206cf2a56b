"""Rows that the tests of this folder share."""

import random

LONG = "tail " + "x" * 50_000 + " " + " ".join(f"w{i}" for i in range(3_000))

#: Null, empty, blank and very long texts, ties, repeated rows, a null id.
ODD = [
    (0, None, "en"), (1, "", "en"), (2, " \t\n ", None), (3, LONG, "en"), (4, "one two three", "fr"), (4, "one two three", "fr"),
    (5, "One TWO three", "fr"), (None, "lost row with a few words", "en"), (6, "été 日本 😀\r\nÉTÉ", None), (7, "...!!! 123 ### |||", "de"),
]


def corpus(seed: int = 0, n: int = 120):
    """Random documents with copies, near copies, shared lines and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    line, passage = " ".join(words(9)), words(60)
    out: list[tuple[int, str | None]] = []
    for i in range(n):
        w = words(r.choice([0, 1, 3, 5, 8, 30, 70, 140]))
        kind = r.random()
        if kind < 0.15 and out:
            out.append((i, r.choice(out)[1]))
            continue
        if kind < 0.45 and out:
            w = (r.choice(out)[1] or "").split()
            for _ in range(r.randint(1, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind < 0.6:
            k = r.randrange(len(w) + 1)
            w = w[:k] + passage[: r.randint(45, 60)] + w[k:]
        text = ""
        for x in w:
            text += x + r.choice([" "] * 8 + ["\n", "\t ", f"\n{line}\n", "  "])
        out.append((i, text if r.random() < 0.9 else text.upper()))
    r.shuffle(out)
    return out
