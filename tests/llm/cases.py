"""Awkward documents that every operator has to survive."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id string, size string, kept string, ids string, _text string, _block string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(seed: int = 3) -> list[tuple]:
    """(doc_id, text, source) with nulls, empties, repeated rows, ties, shared lines and passages and one very long text."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(400)}" for _ in range(900)]
    line = "This is a line that many of the documents share, word for word."
    shared = " ".join(words[:70])
    out = [(0, None, "b"), (1, "", "a"), (2, " \t\n", None), (3, "x", "a"), (4, "x", "a"), (5, " x\n y ", "b"), (6, " x y ", "b")]
    out += [(10 + i, f"{line}\nown {i}\n  {line.upper()}  \n", "a") for i in range(7)]
    out += [(20 + i, f"start {i} {shared} end {i}", "é") for i in range(4)]
    out += [(30, " ".join(words * 30), "b"), (31, "日本語 のテキスト é\x00 <|endoftext|> ▁ a  b\n\n c", None)]
    base = [f"v{rnd.randrange(10**6)}" for _ in range(120)]
    for i in range(6):
        near = list(base)
        near[rnd.randrange(120)] = f"u{i}"
        out.append((40 + i, " ".join(near), "c"))
    out += [(60, "same text again", "a"), (61, "same text again", "a"), (61, "same text again", "a"), (None, "no identifier", "a"), (None, "x", None)]
    rnd.shuffle(out)
    return out


def frame(spark, data=None):
    """The rows as documents with extra columns whose names the operators use themselves."""
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["extra"] * 7) for i, t, s in data], SCHEMA).repartition(3)


def unique(data=None):
    """The rows whose identifier is there and not repeated."""
    data = rows() if data is None else data
    ids = [i for i, *_ in data]
    return [r for r in data if r[0] is not None and ids.count(r[0]) == 1]
