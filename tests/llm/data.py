"""Small documents with everything that is awkward: copies, near copies, shared passages, nulls, empty and long texts, periodic texts, repeated rows."""

import random


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéöñ漢 "[:9]) for _ in range(r.randint(1, 7))) for _ in range(400)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(70))
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.2 and out:
            out.append(r.choice(out))
        elif kind < 0.4 and out:
            w = (r.choice(out) or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind < 0.6:
            out.append(" ".join(words(r.randint(0, 60)) + [passage] + words(r.randint(0, 60))))
        else:
            out.append(" ".join(words(r.choice([0, 1, 2, 5, 50, 200, 400]))))
    return [*out, None, "", " ", "\n\t", "a" * 700, "ab" * 300, "x y " * 200, "Ä" * 260, passage, passage.upper(), "<|endoftext|> a<|endoftext|>  b", " \u2003 é  \u3000漢字 ", "one", "One", "one two"]


def documents(seed=1, n=60):
    return list(enumerate(texts(seed, n)))


def frame(spark, docs, more=True):
    """With columns whose names the operators use themselves."""
    if more:
        return spark.createDataFrame([(t, i, 1, "s", b"", i) for i, t in docs], "text string, doc_id long, tag int, kind string, blob binary, id long")
    return spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
