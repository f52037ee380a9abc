"""Small awkward inputs for the operators, and helpers."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(seed=1, n=60):
    """Nulls, empties, long texts, copies, near copies, shared passages, periodic texts."""
    r = random.Random(seed)
    vocab = ["the", "of", "é", "naïve", "x", "!!", "|"] + ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(k))
    shared = [text(90) for _ in range(4)]
    out = [None, "", " \n ", "one", "same same " * 300, "ab" * 2000, "the of " * 30, text(6000)]
    for _ in range(n):
        k = r.random()
        if k < 0.3:
            out.append(text(r.randint(1, 400)))
        elif k < 0.6:
            out.append(text(r.randint(0, 60)) + r.choice(shared) + text(r.randint(0, 60)))
        else:
            w = (r.choice([x for x in out if x]) or "a").split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    out += out[20:26]
    r.shuffle(out)
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(out)]


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def words(t):
    return [] if t is None else WORD.findall(t.encode())
