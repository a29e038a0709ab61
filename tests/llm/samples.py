"""Small tables with the awkward cases: nulls, empty texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Rows with exact copies, near copies, shared passages, nulls and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßäЖ中") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 25, 49, 50, 51, 120, 300]))]
        if k % 4 == 0:
            body[len(body) // 2 : len(body) // 2] = passage[: rng.choice([49, 50, 60, 70])]
        if k % 9 == 0:
            body = [words[0]] * 160 + body
        if k % 7 == 3 and rows:
            body = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            if body and k % 2:
                body[rng.randrange(len(body))] = "changed"
        seps = [rng.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n", " ", "\x1c"]) for _ in body]
        text = "".join(w + s for w, s in zip(body, seps))
        rows.append((k, text.title() if k % 5 == 0 else text, "en", rng.choice(["b", "a", "é", None]), len(text)))
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", None, 0), (1002, " \n\t ", None, "b", 4), (None, rows[4][1], "en", "a", 1), (None, None, None, None, None), rows[8], rows[8], (5, "another text of the same id " * 9, "en", "b", 1)]
    return rows
