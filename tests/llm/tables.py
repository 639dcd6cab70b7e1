"""Small tables with every awkward row."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empties, very long words and texts, repeated rows."""
    rng = random.Random(seed)
    rows = []
    passage = sentence(rng, 70)
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randrange(3, 60)) + "." for _ in range(rng.randrange(1, 5)))
        if i % 7 == 3:
            text = rows[-1][1]  # a copy
        elif i % 7 == 5 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)  # a near copy
        elif i % 7 == 6:
            text = text + "\n" + passage + "\nand more"
        rows.append((i, text, ["en", "de", None][i % 3], [f"s{i % 4}", None, "hot"][i % 3], len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \t\n ", "en", "s1", 4), (n + 3, "one", "en", "s1", 3), (n + 4, "two words", None, "s2", 9), (n + 5, "x" * 5000, "en", "s1", 5000), (n + 6, sentence(rng, 3000), "en", "hot", None)]
    rows += [(n + 7, "Ünïcode ẞtraße 🙂 " * 40, "de", "s3", None), rows[2], rows[2]]
    return rows
