"""A small table with every awkward row: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, sig string, path string, _row string"
_WORDS = "the of and to in is house garden river stone light music paper window bread morning captain island letter winter summer blue quick".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + (str(r.randrange(90)) if r.random() < 0.5 else "") for _ in range(n))


def texts() -> dict:
    base = prose(1, 160)
    words = base.split()
    near = " ".join(words[:80] + ["changed"] + words[81:])
    return {0: base, 1: near, 2: base.upper(), 3: "", 4: None, 5: "one two three", 6: "one two three", 7: prose(2, 20_000), 8: prose(3, 60), 9: " \n\t ",
            10: "é ñ ß 漢字 𝒳 " * 30 + "\n" + prose(4, 90), 11: "a,!! B,!! " * 80, 12: prose(5, 90) + "\n" + "x | y | z | " * 50, 13: "single", 14: prose(6, 120)}


def table(spark):
    found = texts()
    rows = [(i, t, "en", None if i == 8 else f"src{i % 3}", None if t is None else len(t), "s", "i", "g", "p", "r") for i, t in found.items()]
    rows += [rows[14], (None, prose(9, 70), None, "src1", None, None, None, None, None, None), (15, prose(6, 120), "en", "ä", 1, "s", "i", "g", "p", "r")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
