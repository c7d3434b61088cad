import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, g int, body string, size long, fp long, n_words string, position string"


def texts():
    """Texts with copies, near copies, shared passages, repeats, non-Latin letters, odd white space and nulls."""
    r = random.Random(5)
    words = ["the", "of", "idiot", "Größe", "naïve", "数据", "tion,", "ern", "###", "a|b", "can't", "2024", "<|endoftext|>", "ö", "İx"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = say(60), say(12)
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "two words", "\n\n", "x" * 300, "ab" * 150]
    for i in range(60):
        t = say(r.choice([3, 9, 30, 80, 200]))
        if i % 5 == 0:
            t = t + " " + passage + "\n" + say(5)
        if i % 7 == 0:
            t = "\n".join([t, line, line, say(4), line])
        if i % 11 == 0:
            t = t + "  " + t
        out.append(t)
    base = say(120)
    for _ in range(6):
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base, base, out[20], out[21], base.replace(" ", "  ", 3), say(3000)]
    return out


@pytest.fixture(scope="session")
def rows():
    got = []
    for i, t in enumerate(texts()):
        doc = 1000 - i if i % 3 else i
        got.append((doc, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None, "é"][i % 5], len(t or ""), i, 7, "other", -1, 3, "w", "p"))
    got.append((None, "no id here " * 12, "en", "s1", 0, 1, 1, "b", 0, 0, "w", "p"))
    got.append(got[30])  # a repeated row
    got.append((got[31][0], "same id, other text", "en", "s2", 19, 1, 1, "b", 0, 0, "w", "p"))
    return got


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
