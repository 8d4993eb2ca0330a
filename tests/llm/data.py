"""Documents of the tests: prose from seeded syllables, copies, edits, and the cases every operator must bear."""

import random

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(),
    "fr": "eau ou é è ent ai le en qu oi ch pa vi tre aux ç ment ier".split(),
    "de": "sch ein ung ü ö ge be ver ach ich keit heit zu pf tz ß ent".split(),
}
#: Text with columns whose names clash with those that operators use or make.
SCHEMA = "doc_id long, text string, lang string, score double, kept boolean, _text string, _id string, class_id string, ids string, host string, _digest string"
LONG = 300_000


def prose(r: random.Random, lang: str, words: int) -> str:
    out = []
    for k in range(words):
        w = "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() + "" if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None, str | None]]:
    """(id, text, language) with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    rows = [(k, prose(r, (lang := r.choice(["en", "fr", "de"])), r.randint(30, 250)), lang) for k in range(n)]
    base = [x[1] for x in rows]
    k = n
    for _ in range(12):
        t = r.choice(base)
        rows.append((k, t, None))
        words = t.split(" ")
        words[r.randrange(len(words))] = "edited"
        rows.append((k + 1, " ".join(words), None))
        rows.append((k + 2, prose(r, "en", 20) + "\n" + r.choice(base) + "\n" + prose(r, "de", 20), None))
        k += 3
    return rows


def odd() -> list[tuple[int | None, str | None, str | None]]:
    """Nulls, empty and white texts, repeated rows, a very long text, ties, unusual characters."""
    long = "lorem ipsum dolor " * (LONG // 18)
    return [
        (None, None, None), (None, "null id text here with words", "en"), (1000, None, "en"), (1001, "", "en"), (1002, " \t\n", None), (1003, "x", "en"), (1003, "x", "en"),
        (1004, "1234 5678 !!", "de"), (1005, long, "en"), (1006, "日本語 のテキスト <|endoftext|> 😀 naïve ﬁn", "fr"), (1007, "same text in two rows", "en"), (1008, "same text in two rows", "en"), (1008, "same text in two rows", "en"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, True, "t", "i", "c", "x", "h", "d") for i, t, lang in rows], SCHEMA)
