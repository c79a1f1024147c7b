"""Surrogates for personal data, in DataFrame functions only.

Mentions of e-mail and IP addresses, phone, card, account and social security numbers,
secrets and titled names get keyed replacements of the same type and format: digits stand
for digits, letters for letters of their case, a title keeps its gender and a name its
script, valid check digits stay valid. A value has one surrogate in all documents, however
its mention is written: numbers are compared without separators, e-mail addresses without
case, and names that a document gives with a title are replaced there without it too. A
surrogate depends on the key, the value and, where surrogates of two values meet or hit a
value that occurs, on the number of tries it takes until all are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, let, table

# Titles by gender, and given names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Srta", "Señora", "Signora", "г-жа"],
    "m": ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Signor", "г-н"],
    "n": ["Dr", "Prof", "Doctor", "Professor"],
}
SYLLABLES = (["Bar", "Cor", "Dal", "Fen", "Gar", "Hal", "Kel", "Lan", "Mar", "Nor", "Pel", "Ros", "Sal", "Tor", "Val", "Wes"], ["a", "be", "di", "e", "ga", "i", "ke", "lo", "me", "no", "o", "ra", "se", "ti", "u", "vi"], ["berg", "dal", "feld", "ford", "ham", "ley", "man", "mont", "ner", "ram", "rell", "sen", "son", "stein", "ton", "well"])
SYLLABLES_CYRILLIC = (["Бар", "Вол", "Гор", "Дан", "Зор", "Кам", "Лав", "Мор", "Нов", "Пет", "Ром", "Сав", "Тар", "Фил", "Чер", "Яр"], ["а", "бе", "ви", "го", "ди", "е", "ке", "ло", "ме", "но", "о", "ра", "се", "ти", "у", "ша"], ["ев", "ов", "ин", "кин", "нов", "рев", "шин", "лов"])

#: Endings of given names by gender and script.
GIVEN = {"f": ["a", "ella", "ina", "ira"], "m": ["an", "ard", "o", "us"], "n": ["el", "in", "is", "y"]}
GIVEN_CYRILLIC = {"f": ["а", "елла", "ина", "ия"], "m": ["ан", "ей", "ий", "ор"], "n": ["аша", "ель", "ик", "я"]}

_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for g in TITLES.values() for t in g) + ")"
EMAIL = r"[\p{L}\p{N}_%+-](?:[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::(?:{_HEX}:){{1,6}}{_HEX})(?![0-9A-Za-z:])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d|\.\d)"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,64}|(?:AKIA|ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"
NAME = rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?"
MENTION = "|".join([EMAIL, SECRET, IP, IPV6, IBAN, PHONE, SSN, CARD, NAME])
#: A cheap test that every mention passes.
HINT = rf"[0-9@]|(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}"


#: Kinds whose mentions may be written with different separators.
NUMBERS = ("phone", "ssn", "card", "iban")


def kind(mention: Column) -> Column:
    whole = lambda p: mention.rlike(rf"\A(?:{p})\z")
    names = F.when(mention.contains("@"), F.lit("email"))
    for name, pattern in (("secret", SECRET), ("ip", IP), ("ipv6", IPV6), ("phone", PHONE), ("ssn", SSN), ("card", CARD), ("iban", IBAN)):
        names = names.when(whole(pattern), F.lit(name))
    return names.otherwise(F.lit("name"))


def parts(mention: Column) -> Column:
    """What of a mention gets a surrogate of its own: [(kind, value)]. A name has a given name and a surname, or a surname."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.\z", "")
    gender = reduce(lambda c, g: c.when(title.isin(TITLES[g]), F.lit("given_" + g)), ("m", "n"), F.when(title.isin(TITLES["f"]), F.lit("given_f")))
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    surname = part(F.lit("surname"), F.element_at(words, -1))
    name = F.when(F.size(words) > 2, F.array(part(gender, F.get(words, F.lit(1))), surname)).otherwise(F.array(surname))
    of = kind(mention)
    value = F.when(of.isin("email", "ipv6"), F.lower(mention)).when(of.isin(*NUMBERS), F.regexp_replace(mention, r"[^\p{L}\p{N}+]", "")).otherwise(mention)
    return F.when(of == "name", name).otherwise(F.array(part(of, value)))


def _digit(digest: Column, i: Column, n: int) -> Column:
    """A number under n (at most 256) from the i-th (from 0) of 32 pairs of hexadecimal digits."""
    return (F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") % n).cast("int")


def _same_format(value: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits, letters for letters of the same case and script, all else as it is."""
    lower = F.lit("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz")
    n = 6 if hexadecimal else 26

    def one(i: Column) -> Column:
        c = F.substr(value, i + 1, F.lit(1))
        pick = lambda alphabet, k: F.substr(alphabet, _digit(digest, i, k) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), pick(F.lit("0123456789"), 10))
            .when(c.rlike(r"[а-я]"), pick(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), 27))
            .when(c.rlike(r"\p{Ll}"), pick(lower, n))
            .when(c.rlike(r"\p{Lu}"), F.upper(pick(lower, n)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _luhn(value: Column) -> Column:
    """Sum of the Luhn rule over a string's digits."""
    digits = F.reverse(F.regexp_replace(value, r"\D", ""))
    each = F.transform(F.split(digits, ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)).cast("int"))


def _card(value: Column, digest: Column) -> Column:
    """A number whose Luhn sum is a multiple of ten where that of the value is."""
    other = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_same_format(value, digest), F.lit(2), F.length(value) - 1))

    def fixed(x: Column) -> Column:
        body = F.substr(x, F.lit(1), F.length(x) - 1)
        return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    return F.when(_luhn(value) % 10 == 0, let(other, fixed)).otherwise(other)


def _iban(value: Column, digest: Column) -> Column:
    """An account number of the same country and form; its check digits are valid, whatever those of the value are."""
    country, rest = F.substr(value, F.lit(1), F.lit(2)), _same_format(F.substr(value, F.lit(5), F.length(value) - 4), digest)

    def checked(body: Column) -> Column:
        # Letters count as 10 to 35; the remainder by 97 is taken from left to right.
        step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
        left = F.aggregate(F.filter(F.split(F.upper(F.concat(body, country, F.lit("00"))), ""), lambda c: c != ""), F.lit(0), step)
        return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), body)

    return let(rest, checked)


def _pick(pool: list[str], digest: Column, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, pool)), _digit(digest, at, len(pool)))


def _name(pools: tuple[list, list, list], digest: Column, more: Column) -> Column:
    """A name of syllables, as many more of the middle ones as asked for."""
    middle = F.array_join(F.transform(F.sequence(F.lit(0), more), lambda i: _pick(pools[1], digest, i + 2)), "")
    return F.concat(_pick(pools[0], digest, F.lit(0)), middle, _pick(pools[2], digest, F.lit(1)))


def surrogate(kind_: Column, value: Column, attempt: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind_, value, attempt.cast("string")), 256)

    def of(d: Column) -> Column:
        cyrillic = value.rlike(r"\A\p{IsCyrillic}")
        local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_digit(d, i, 254) + 1).cast("string")), ".")
        kept = r"\A(?:\+(?:[17]|\d\d)|0)?"  # the country's code or the trunk prefix
        out = F.when(kind_ == "email", F.concat(_same_format(local, d), F.lit("@"), _same_format(F.regexp_extract(domain, r"\A[^.]+", 0), F.reverse(d)), F.lit(".example")))
        out = out.when(kind_ == "ip", octets).when(kind_ == "card", _card(value, d)).when(kind_ == "iban", _iban(value, d)).when(kind_ == "ipv6", _same_format(value, d, True))
        out = out.when(kind_ == "secret", F.when(value.rlike(r"\A[0-9a-fA-F]+\z"), _same_format(value, d, True)).otherwise(_same_format(value, d)))
        out = out.when(kind_ == "phone", F.concat(F.regexp_extract(value, kept, 0), _same_format(F.regexp_replace(value, kept, ""), d)))
        # Every other try makes names longer, so that the pool outgrows any corpus.
        more = F.least((attempt / 2).cast("int"), F.lit(20))
        named = lambda latin, other: F.when(cyrillic, _name((*SYLLABLES_CYRILLIC[:2], other), d, more)).otherwise(_name((*SYLLABLES[:2], latin), d, more))
        shout = lambda c: F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(c)).otherwise(c)
        for g in GIVEN:
            out = out.when(kind_ == "given_" + g, shout(named(GIVEN[g], GIVEN_CYRILLIC[g])))
        out = out.when(kind_ == "surname", shout(named(SYLLABLES[2], SYLLABLES_CYRILLIC[2])))
        return out.otherwise(_same_format(value, d))

    return let(digest, of)


def written_as(mention: Column, kind_: Column, new: Column) -> Column:
    """A surrogate in the form of the mention: separators of numbers, case of e-mail addresses."""

    def one(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(F.regexp_replace(new, r"[^\p{L}\p{N}]", ""), nth, F.lit(1))).otherwise(c)

    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), "")
    first = F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2), F.length(new)))
    mail = F.when(F.upper(mention) == mention, F.upper(new)).when(mention.rlike(r"\A\p{Lu}"), first).otherwise(new)
    return F.when(kind_.isin(*NUMBERS), number).when(kind_ == "email", mail).otherwise(new)


def distinct_surrogates(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, surrogate) with distinct surrogates within a kind, none of which is itself a value of the kind; all parts of names are one kind."""
    step = 0
    space = F.when(F.col("kind").startswith("given") | (F.col("kind") == "surname"), F.lit("name")).otherwise(F.col("kind")).alias("space")
    drawn = lambda df: df.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
    current = scratch.save(drawn(values.withColumn("attempt", F.lit(0))), "surrogates-0")
    real = scratch.save(values.select(space, F.col("value").alias("surrogate"), F.lit(True).alias("real")).distinct(), "real")
    while True:
        spaced = current.withColumn("space", space)
        first = spaced.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        clash = spaced.join(first, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left").withColumn("clash", (F.col("first.kind") != F.col("kind")) | (F.col("first.value") != F.col("value")) | F.coalesce("real", F.lit(False)))
        if clash.where("clash").isEmpty():
            return current.select("kind", "value", "surrogate")
        step += 1
        scratch.drop(f"surrogates-{step - 2}")
        kept = clash.where("NOT clash").select("kind", "value", "attempt", "surrogate")
        again = drawn(clash.where("clash").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        current = scratch.save(kept.unionByName(again), f"surrogates-{step}")


def replace_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, mentions_col: str | None = None, key: str = "locuslake") -> DataFrame:
    """The rows with all their columns, personal data in ``text_col`` replaced.

    ``length_col`` is set to the new length where the text changed; ``mentions_col`` is added
    with the number of mentions. Null and empty texts stay as they are. Rows are told apart by
    id and text, null ids too; repeated rows get equal results. An empty table gives no rows.
    Columns of the table may have any names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col(text_col)
    found_, row_, map_, names_, n_ = fresh(docs, "mentions", "row", "map", "names", "n")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)))
    has = F.coalesce(F.size(found) > 0, F.lit(False))
    rest = docs.where(~has).withColumn(n_, F.lit(0).cast("long"))
    with_any = docs.where(text.rlike(HINT)).withColumn(found_, F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))).where(F.size(found_) > 0)
    hits = scratch.save(with_any.withColumn(row_, F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))), "hits")
    mentions = hits.select(F.col(row_).alias("row"), F.explode(F.array_distinct(found_)).alias("mention")).distinct()
    by_mention = scratch.save(mentions.select("mention").distinct().withColumn("parts", parts(F.col("mention"))), "mentions")
    exploded = by_mention.select("mention", F.posexplode("parts").alias("at", "part")).select("mention", "at", "part.kind", "part.value")
    surrogates = distinct_surrogates(exploded.select("kind", "value").distinct(), key, scratch)
    joined = exploded.join(surrogates, ["kind", "value"]).groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "value", "surrogate"))).alias("new"))
    words = F.array_join(F.transform("new", lambda s: s["surrogate"]), " ")
    titled = F.element_at("new", -1)["kind"] == "surname"
    alone = F.get("new", F.lit(0))
    replacement = F.when(titled, F.concat_ws(" ", F.substring_index("mention", " ", 1), words)).otherwise(written_as(F.col("mention"), alone["kind"], alone["surrogate"]))
    bare = F.when(titled, F.transform("new", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), s["surrogate"].alias("surrogate"))))
    table_ = scratch.save(joined.select("mention", replacement.alias("replacement"), bare.alias("bare")), "replacements")
    by_row = mentions.join(table_, "mention").groupBy("row").agg(F.collect_set(F.struct("mention", "replacement")).alias("entries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bare")))).alias("names"))
    # A name that is a given name here and a surname there has the surrogate of the first kind where it stands alone.
    values = F.array_distinct(F.transform("names", lambda s: s["value"]))
    single = F.transform(values, lambda v: F.struct(v.alias("mention"), F.get(F.filter("names", lambda s: s["value"] == v), F.lit(0))["surrogate"].alias("replacement")))
    longest = F.array_sort(values, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})")))
    by_row = by_row.select(F.col("row").alias(row_), F.map_from_entries(F.concat("entries", single)).alias(map_), pattern.alias(names_))
    filled = scratch.save(hits.join(by_row, row_), "filled")
    scratch.drop("hits", "mentions", "real", "replacements")

    def replaced(rows: DataFrame, whole: Column) -> DataFrame:
        pieces, places = F.split(text, whole, -1), F.regexp_extract_all(text, whole, F.lit(0))
        new = F.array_join(F.zip_with(pieces, F.transform(places, lambda m: F.element_at(F.col(map_), m)), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
        return rows.withColumn(n_, F.size(places).cast("long")).withColumn(text_col, new)

    named = F.concat(F.lit(MENTION + "|"), F.col(names_))
    filled = replaced(filled.where(F.col(names_).isNull()), F.lit(MENTION)).unionByName(replaced(filled.where(F.col(names_).isNotNull()), named))
    if length_col:
        filled = filled.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    out = filled.select(*docs.columns, n_).unionByName(rest.select(*docs.columns, n_))
    return out.withColumnRenamed(n_, mentions_col) if mentions_col else out.drop(n_)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, mentions_col="n_mentions")
