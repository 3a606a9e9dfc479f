"""Small tables with every awkward case, shared by the tests of the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string, node string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
SECRET = 'token = "0b96a8c8d79c4a5085c919698889f59b72"'


def prose(seed, words=80):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(["an", "the", "or", "in", "es", "tion", "re"]) for _ in range(pick.randint(1, 4))) for _ in range(words))


def documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, other scripts, clashing columns."""
    texts = {
        1: prose(1), 2: prose(2), 3: None, 4: "", 5: LONG, 6: prose(6) + " " + SECRET, 7: prose(1), 8: "  \n\t ",
        9: "日本語 テキスト ÉÀß İstanbul don't <|endoftext|> ½\n" + prose(9), 10: prose(10) + " extra", 11: prose(10),
    }
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "k", "s", "x", "n") for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, prose(12), None, None, None, None, None, None, None), (2, prose(13), "de", None, None, "k", "s", "x", "n")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]
