"""Documents that every operator must take: nulls, blanks, ties, repeats, long texts and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, size int, score double, record string, start string, part string, digest binary"


def prose(seed, words, alphabet=400):
    rng = random.Random(seed)
    made = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(alphabet)]
    return " ".join(rng.choice(made) for _ in range(words))


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def rows():
    base, passage = prose(1, 120), prose(2, 90)
    texts = [base, base, edited(base, 1, 2), edited(base, 2, 2), edited(base, 3, 9), None, "", " \t\n ", "one", "One", "a b c d", "a b c d e", "é" * 300 + " ü " * 200, "ab " * 500, "x" * 3000]
    texts += [prose(10 + i, 60) + " " + passage + " " + prose(50 + i, 40 + i) for i in range(4)]
    texts += [prose(100 + i, 30 + 20 * i) for i in range(12)] + [prose(7, 20000)]
    texts += ["line\nline\nother\n\nline " + prose(5, 25), "%%% ### $$$ " * 30, "naïve café " + passage[:200], "\x00\x1f<|endoftext|>’s don't 12 3"]
    ids = [*range(len(texts) - 2), None, None]
    out = [(i, t, "en", "src0", len(t) if t is not None else None, 1, "k", 2, 0.5, "r", "s", "p", b"d") for i, t in zip(ids, texts, strict=True)]
    return [*out, out[0], out[20]]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
