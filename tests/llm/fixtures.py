"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

COMMON = {
    "en": "the of and to in that was for it with on as be at by this had not are but from or have an they which one you were all".split(),
    "fr": "le la les de des un une et que qui dans pour par sur avec pas plus ne se ce il elle sont mais comme nous vous leur ou où".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for _ in range(n):
        w = rng.choice(COMMON[lang]) if rng.random() < 0.5 else "".join(rng.choice(["ba", "ti", "on", "er", "lu", "mi", "sha", "ed"] if lang == "en" else ["é", "eau", "oi", "ment", "ç", "tre", "ai"]) for _ in range(rng.randint(1, 3)))
        out.append(w + ("." if rng.random() < 0.08 else ""))
    return " ".join(out)


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, fp, word): the last two clash with names used inside operators."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = prose(rng, lang, rng.choice([3, 20, 80, 200]))
        rows.append((i, text, lang, f"s{rng.randint(0, 4)}"))
    base = prose(rng, "en", 150)
    for k in range(12):  # copies and near copies
        words = base.split(" ")
        if k > 6:
            words[k * 7] = "changed"
        rows.append((1000 + k, " ".join(words), "en", "s0"))
    long = prose(rng, "fr", 6000)
    rows += [
        (2000, None, "en", "s1"),
        (2001, "", None, None),
        (2002, " \t\n ", "en", "s1"),
        (2003, "one", "en", "s2"),
        (2004, long, "fr", "s2"),
        (2004, long, "fr", "s2"),  # a repeated row
        (2005, "123 456 !!", "en", "s3"),
        (None, prose(rng, "en", 60), "en", "s3"),
        (2006, "A\x1fB c ß É <|endoftext|> it's 12,5 é", None, "s4"),
    ]
    return [(*r, len(r[1] or ""), 7, "x") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, word string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
