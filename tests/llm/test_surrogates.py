"""Surrogates: nothing found is left, types and formats stay, one entity is replaced alike, two never share one."""
import re

import pytest

from parcelwise.llm import op10_surrogates as op

TEXT = """Mail hein.19@mail5.example.com or HEIN.19@MAIL5.EXAMPLE.COM, call +1 (988) 555-2485 1999, or +49 30 1234567.
Card 4041894974608795 and 4041 8949 7460 8795 not 4041894974608796. IP 42.144.35.254. 10.0.0.7 192.168.1.1 1.2.3.4.5
IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 ssn 123-45-6789 Mrs. Jane Miller-Smith, Herr Bauer, г-н Иван Петров."""
SECRETS = ["hein.19", "555-2485", "1234567", "4041894974608795", "8949 7460", "42.144", "10.0.0.7", "192.168.1.1", "3704", "12345698765432", "123-45-6789", "Jane", "Miller", "Bauer", "Иван"]
SCHEMA = "doc_id long, text string, n_entities string, _new string"


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [(1, TEXT, "a", "b"), (2, "clean text, 12 and a@b", "a", "b"), (3, None, None, None), (4, "", None, None), (None, "hein.19@mail5.example.com", None, None),
            (5, "x " * 100_000 + "42.144.35.254", None, None), (5, "x " * 100_000 + "42.144.35.254", None, None), (6, "€𝒳 +1 (988) 555-2485€", None, None)]
    return [r.asDict() for r in op.replace_entities(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]


def by_id(replaced, i):
    return next(r for r in replaced if r["doc_id"] == i)


def test_entities_go_and_the_rest_stays(replaced):
    out = by_id(replaced, 1)["text"]
    assert not [s for s in SECRETS if s in out]
    assert "4041894974608796" in out and "1.2.3.4.5" in out and " 1999," in out
    shape = lambda t: re.sub(r"\d", "9", t).split()
    assert len(shape(out)) == len(shape(TEXT))
    assert by_id(replaced, 2)["text"] == "clean text, 12 and a@b" and by_id(replaced, 2)["n_entities"] == 0
    assert by_id(replaced, 3)["text"] is None and by_id(replaced, 4)["text"] == ""
    assert len(replaced) == 8


def test_formats(replaced):
    out = {}
    for e in by_id(replaced, 1)["entities"]:
        out.setdefault(e["kind"], []).append(e["surrogate"])
    assert out["email"][0].upper() == out["email"][1] and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.example\.com", out["email"][0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out["phone"][0]) and out["phone"][1].startswith("+49 ")
    assert luhn(out["card"][0]) and out["card"][1].replace(" ", "") == out["card"][0] and out["card"][0][0] == "4"
    assert out["ip"][1].startswith("10.") and out["ip"][2].startswith("192.168.")
    for iban in out["iban"]:
        flat = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert out["name"][0].startswith("Mrs. ") and re.search("[а-я]", out["name"][2])
    assert any(f" {n} " in out["name"][0] + " " for n in op.GIVEN["latin"]["f"])


def test_one_entity_one_surrogate(replaced):
    mail = by_id(replaced, 1)["entities"][0]["surrogate"]
    assert by_id(replaced, None)["text"] == mail
    long = [r["text"] for r in replaced if r["doc_id"] == 5]
    assert long[0] == long[1] and long[0].endswith(next(e["surrogate"] for e in by_id(replaced, 1)["entities"] if e["kind"] == "ip"))
    assert by_id(replaced, 6)["text"] == f"€𝒳 {next(e['surrogate'] for e in by_id(replaced, 1)['entities'] if e['kind'] == 'phone')}€"


def test_surrogates_are_distinct_and_no_real_entity(spark):
    # a crowded space: private addresses with two free octets, more than birthdays allow
    entities = [("ip", f"192.168.{a}.{b}") for a in range(1, 120) for b in range(1, 60)]
    out = op.assign(spark.createDataFrame(entities, "kind string, norm string")).collect()
    chosen = {r["chosen"] for r in out}
    assert len(out) == len(entities) == len(chosen) and not chosen & {n for _, n in entities}


def test_key_matters(spark):
    df = spark.createDataFrame([("email", "a.b@c.org")], "kind string, norm string")
    assert op.assign(df, "k1").first()["chosen"] != op.assign(df, "k2").first()["chosen"]


def test_long_runs_are_fast(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1.1." * 80_000, "a.b@" * 80_000, "(1" * 100_000, "Mr. A" * 60_000]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert op.replace_entities(df).count() == len(texts)
