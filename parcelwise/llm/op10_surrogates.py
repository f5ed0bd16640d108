"""Personal data replaced by keyed surrogates.

Entities (mail addresses, international and national phone numbers, payment cards, bank accounts, social security numbers, IP
addresses, names behind a title) are detected by expression and, where they carry one, by checksum. Every distinct entity gets
a surrogate from a keyed hash of its type and normal form, so the same entity is replaced alike wherever and however it is
written. Surrogates keep type and format: digits stay digits, checksums hold, the country of a number or account and the class
of an address stay, a name keeps its title and its gender and script. Two entities never share a surrogate and none equals a
real entity of the corpus: whoever collides draws again, until none does.

Everything is built-in functions. Texts without an entity pass untouched and unshuffled. Distinct entities are found by
partial aggregation, and only mentions, never texts, meet them.

Nulls: a null text stays null; a null or repeated doc_id is treated row by row. An empty table gives an empty table. Extra
columns stay, but for those named like an added one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

NAME = "op10_pii_surrogates"
ORACLE_SQL = None  # tests compare with a plain search and check each property of the surrogates
KEY = "corpus-surrogates"

_NAME_PART = r"\p{Lu}\p{Ll}+"
TITLES = {
    "f": "Mrs|Ms|Miss|Madam|Frau|Señora|Sra|Mme|Madame|г-жа|госпожа|κυρία",
    "m": "Mr|Sir|Herr|Señor|Sr|Monsieur|г-н|господин|κύριος",
}
#: What stands before and after every entity, and behind entities that end in a digit.
_EDGE, _STOP, _ALONE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", r"(?![\p{L}\p{N}-])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: kind: expression behind the edge. The order decides where two begin alike. Runs are bounded or possessive: no text makes a
#: match slow, and each begins with what excludes most places at once.
KINDS = {
    "email": r"[\p{L}\p{N}](?<![._%+-].)[\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _STOP,
    "phone": r"(?=[+(0-9])(?<![+])(?:(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + _STOP + r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}" + _STOP
             + r"|(?<![.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}-]|\.[0-9]))",
    "card": r"(?=[0-9])(?<!-)(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4} [0-9]{4} |-[0-9]{4}-[0-9]{4}-)[0-9]{4}|[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5})" + _ALONE,
    "ssn": r"[0-9]{3}(?<!-[0-9]{3})-[0-9]{2}-[0-9]{4}" + _ALONE,
    "ip": r"(?=[0-9])(?<![0-9]\.)(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?[\p{L}\p{N}])",
    "name": f"(?:{TITLES['f']}|{TITLES['m']})" + rf"\.? {_NAME_PART}(?:[ -]{_NAME_PART}){{0,2}}" + _STOP,
}
PATTERN = _EDGE + "(?:" + "|".join(KINDS.values()) + ")"
#: Texts without a digit, an at sign or a title have no entity; this is seen faster.
HINT = f"[0-9@]|(?=[MSFHгκ])(?:{TITLES['f']}|{TITLES['m']})"
#: Given names by script and gender, syllables of family names by script.
GIVEN = {
    "latin": {"f": "Ada Berta Clara Dora Elena Flora Greta Helga Irma Julia Karla Lena Marta Nora Olga Paula".split(),
              "m": "Adam Boris Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Nils Oskar Paul".split()},
    "cyrillic": {"f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина".split(), "m": "Антон Борис Виктор Глеб Денис Егор Захар Иван".split()},
    "greek": {"f": "Άννα Δάφνη Ελένη Ζωή Ηρώ Θάλεια Μαρία Σοφία".split(), "m": "Άρης Γιώργος Δήμος Ηλίας Θάνος Κώστας Νίκος Πέτρος".split()},
}
SYLLABLES = {"latin": "bra den fel gor hal kin lam mor nes pol ris sta tam ven wil zan".split(), "cyrillic": "бра вел гор дан зим кор лев мир".split(),
             "greek": "βελ γορ δαν ζερ καλ λαν μορ ναξ".split()}
MAX_DRAWS = 64


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """The weighted digit sum of a card number, modulo 10; 0 if it is valid."""
    turned = F.reverse(F.transform(F.filter(F.split(number, ""), lambda d: d != ""), lambda d: d.try_cast("int")))
    terms = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + t) % 10


def mod97(letters: Column) -> Column:
    """Digits and capitals (10 to 35) read as one decimal number, modulo 97."""
    values = F.transform(F.split(letters, ""), lambda c: F.when(c == "", -1).when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 0, a).when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97))


def kind_of(raw: Column) -> Column:
    """The kind that the expression found, null for numbers whose checksum fails."""
    found = F.lit(None).cast("string")
    for kind, p in reversed(KINDS.items()):
        found = F.when(raw.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(found)
    number = digits(raw)
    compact = F.replace(raw, F.lit(" "), F.lit(""))
    fails = (((found == "card") & (luhn_sum(number) != 0)) | ((found == "phone") & ~F.length(number).between(7, 15))
             | ((found == "iban") & (mod97(F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))) != 1)))
    return F.when(fails, None).otherwise(found)


def normal(kind: Column, raw: Column) -> Column:
    """What all ways to write an entity have in common."""
    title = F.regexp_extract(raw, r"^([^ ]+) ", 1)
    gender = F.when(title.rlike(f"^(?:{TITLES['f']})"), "f").otherwise("m")
    return (F.when(kind == "email", F.lower(raw)).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
            .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits(raw))).when(kind == "ip", raw)
            .when(kind == "name", F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(raw, r"^[^ ]+ ", "")))).otherwise(digits(raw)))


class _Draw:
    """Keyed bytes for one entity: three SHA-256 digests, read by position."""

    def __init__(self, *parts: Column):
        base = F.concat_ws("\x1f", *parts)
        self.hex = F.concat(*[F.sha2(F.concat(base, F.lit(f"\x1f{i}")).cast("binary"), 256) for i in range(3)])

    def at(self, i) -> Column:
        i = F.lit(i) if isinstance(i, int) else i
        return F.conv(F.substring(self.hex, 2 * (i % 96) + 1, F.lit(2)), 16, 10).cast("int")

    def pick(self, values: list[str], i) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self.at(i) % len(values) + 1)

    def like(self, text: Column) -> Column:
        """Digits for digits, letters for letters of the same case and script, all else as it is."""
        def one(c: Column, i: Column) -> Column:
            b = self.at(i)

            def of(alphabet: str) -> Column:
                return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))

            cyrillic, greek, latin = "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"
            lower = F.when(c.rlike(r"\p{IsCyrillic}"), of(cyrillic)).when(c.rlike(r"\p{IsGreek}"), of(greek)).otherwise(of(latin))
            return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(lower)).when(c.rlike(r"\p{L}"), lower).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")


def surrogate(kind: Column, norm: Column, draw_no: Column, key: str = KEY) -> Column:
    """The normal form of an entity's surrogate."""
    d = _Draw(F.lit(key), kind, norm, draw_no.cast("string"))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    by_domain = _Draw(F.lit(key), F.lit("domain"), domain)
    top = F.substring_index(domain, ".", -1)
    top = F.when(top.isin("com", "net", "org"), top).otherwise("org")
    email = F.concat(d.like(local), F.lit("@"), by_domain.like(F.substring_index(domain, ".", 1)), F.lit(".example."), top)
    plus = F.when(norm.startswith("+1") | norm.startswith("+7"), 2).when(norm.startswith("+"), 3).otherwise(0)
    rest = d.like(F.substring(norm, plus + 2, F.length(norm)))
    phone = F.concat(F.left(norm, plus), (d.at(95) % 8 + 2).cast("string"), rest)
    body = F.concat(F.left(norm, F.lit(1)), d.like(F.substring(norm, F.lit(2), F.length(norm) - 2)))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string"))
    account, country = d.like(F.substring(norm, F.lit(5), F.length(norm))), F.left(norm, F.lit(2))
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    ssn = F.concat((d.at(95) % 5 + 1).cast("string"), d.like(F.substring(norm, F.lit(2), F.lit(8))))
    octets = [(d.at(i) % 254 + 1).cast("string") for i in range(4)]
    ip = (F.when(norm.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(norm, ".", 1), *octets[1:]))
          .when(norm.rlike(r"^(192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."), F.concat_ws(".", F.substring_index(norm, ".", 2), *octets[2:]))
          .otherwise(F.concat_ws(".", (d.at(0) % 100 + 11).cast("string"), *octets[1:])))
    gaps, name = F.regexp_replace(F.substring(norm, F.lit(3), F.length(norm)), "[^ -]", ""), None  # one or two, or none
    parts = F.length(gaps) + 1
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
        given = [F.when(norm.startswith("f:"), d.pick(GIVEN[script]["f"], i)).otherwise(d.pick(GIVEN[script]["m"], i)) for i in (10, 11)]

        def family(start: int, script: str = script) -> Column:
            # later draws add a syllable, so that no number of names exhausts them
            upto = F.lit(start + 2) + F.floor(draw_no / 2).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(start), upto), lambda i: d.pick(SYLLABLES[script], i)), "")

        # what a hyphen ties to the last word is a family name too
        middle = F.when(F.endswith(gaps, F.lit("-")), family(48)).otherwise(given[1])
        front = F.when(parts == 1, "").when(parts == 2, F.concat(F.when(gaps == "-", family(48)).otherwise(given[0]), gaps))
        front = front.otherwise(F.concat(given[0], F.left(gaps, F.lit(1)), middle, F.right(gaps, F.lit(1))))
        full = F.concat(F.left(norm, F.lit(2)), F.lower(F.concat(front, family(0))))
        name = F.when(norm.rlike(test), full) if name is None else name.when(norm.rlike(test), full)
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", ssn)
            .when(kind == "ip", ip).when(kind == "name", name))


def written(kind: Column, raw: Column, chosen: Column) -> Column:
    """A surrogate in the way that the entity was written."""
    def fill(letters: str, source: Column) -> Column:
        return F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(letters), F.substring(
            source, F.length(F.regexp_replace(F.left(raw, i + 1), letters.replace("[", "[^"), "")), F.lit(1))).otherwise(c)), "")

    title = F.concat(F.regexp_extract(raw, r"^([^ ]+) ", 1), F.lit(" "))
    apart = F.replace(F.substring(chosen, F.lit(3), F.length(chosen)), F.lit("-"), F.lit("- "))
    capitals = F.replace(F.initcap(apart), F.lit("- "), F.lit("-"))
    return (F.when(kind == "email", F.when(raw == F.upper(raw), F.upper(chosen)).otherwise(chosen)).when(kind == "iban", fill("[A-Z0-9]", chosen))
            .when(kind == "ip", chosen).when(kind == "name", F.concat(title, capitals))
            .otherwise(fill("[0-9]", digits(chosen))))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, chosen) for distinct (kind, norm); chosen is unique by kind and never a norm."""
    settled, pending = None, entities.withColumn("draw", F.lit(0))
    for _ in range(MAX_DRAWS):
        tried = cut_lineage(pending.withColumn("chosen", surrogate(F.col("kind"), F.col("norm"), F.col("draw"), key)))
        real = entities.select("kind", F.col("norm").alias("chosen"), F.lit(1).alias("taken"))
        taken = real if settled is None else real.unionByName(settled.select("kind", "chosen", F.lit(1).alias("taken")))
        first = F.row_number().over(Window.partitionBy("kind", "chosen").orderBy(F.xxhash64("norm"), "norm"))
        seen = tried.withColumn("first", first).join(taken.distinct(), ["kind", "chosen"], "left")
        seen = cut_lineage(seen.withColumn("good", (F.col("first") == 1) & F.col("taken").isNull()))
        good = seen.filter("good").select("kind", "norm", "chosen")
        settled = good if settled is None else settled.unionByName(good)
        pending = seen.filter("NOT good").select("kind", "norm", (F.col("draw") + 1).alias("draw"))
        if pending.isEmpty():
            return settled
    raise ValueError(f"no surrogate is left after {MAX_DRAWS} draws")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with surrogates in the text, `n_entities`, and `entities` as array of struct(kind, surrogate) in text order."""
    docs = docs.drop("n_entities", "entities")
    none = F.array().cast("array<struct<kind: string, surrogate: string>>")
    has = F.coalesce(F.col(text_col).rlike(HINT) & F.col(text_col).rlike(PATTERN), F.lit(False))
    clean = docs.filter(~has).withColumns({"n_entities": F.lit(0).cast("bigint"), "entities": none})
    # rows are known by all they hold: equal rows have equal results
    dirty = docs.filter(has).withColumn("__pii_row", F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_col), 256))
    found = dirty.select("__pii_row", F.posexplode(F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0))).alias("at", "raw"))
    found = found.distinct().withColumn("kind", kind_of(F.col("raw"))).withColumn("norm", normal(F.col("kind"), F.col("raw")))
    found = cut_lineage(found)
    chosen = assign(cut_lineage(found.filter("kind IS NOT NULL").select("kind", "norm").distinct()), key)
    found = found.join(chosen, ["kind", "norm"], "left")
    found = found.withColumn("new", F.when(F.col("chosen").isNotNull(), written(F.col("kind"), F.col("raw"), F.col("chosen"))))
    new = found.groupBy("__pii_row").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "raw", "new"))).alias("__pii_new"))
    dirty = dirty.join(new, "__pii_row").drop("__pii_row")
    between = F.split(text_col, PATTERN, -1)
    put = F.transform("__pii_new", lambda e: F.coalesce(e["new"], e["raw"]))
    text = F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    real = F.filter("__pii_new", lambda e: e["new"].isNotNull())
    entities = F.transform(real, lambda e: F.struct(e["kind"].alias("kind"), e["new"].alias("surrogate")))
    dirty = dirty.withColumns({"n_entities": F.size(real).cast("bigint"), "entities": entities}).withColumn(text_col, text).drop("__pii_new")
    return clean.unionByName(dirty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_entities", "entities")
