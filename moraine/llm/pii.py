"""Surrogates for personal data, in DataFrame functions only.

Emails, phone numbers, card numbers, national numbers, IPv4 addresses and titled names are found with one regex. What an
entity is called stays the same wherever and however it is written: its canonical form is hashed under a secret key, and the
hash picks a replacement of the same type (gender and script of names, country code and layout of phones, first digit and
check-sum validity of cards, letter case and shape of emails). Names are replaced word by word, so `Mr. Jon Doe` and `Mr. Doe`
keep sharing a surname.

The dictionary of distinct entities, not the texts, is checked for collisions: two entities of a type may not share a
surrogate, and no surrogate may be another real entity; those in the way draw again, round by round. Only entities that drew
again are looked up later; every other surrogate follows from the entity and the key alone, without a join.

Defined cases: null and empty texts stay as they are and have no entities; repeated rows get equal results; a null doc_id is
as good as any; an empty table gives an empty result; texts are taken whole. Texts without entities come back unchanged.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import cut, read

#: Titles by gender of the name that follows, and parts that surrogate names are made of, by script.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "κυρία")
EITHER = ("Dr", "Prof")
GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Conrad", "Dorian", "Edgar", "Felix", "Gustav", "Hector", "Ivo", "Jonas", "Kilian", "Leander", "Marius", "Nestor", "Oskar", "Pascal"),
    ("latin", "f"): ("Agnes", "Bianca", "Clara", "Delia", "Elena", "Flora", "Greta", "Helena", "Irma", "Judith", "Karla", "Livia", "Marta", "Nadia", "Olivia", "Paula"),
    ("latin", "x"): ("Alex", "Billie", "Chris", "Dana", "Eden", "Finley", "Gale", "Harper", "Indigo", "Jamie", "Kim", "Lou", "Morgan", "Noel", "Quinn", "Robin"),
    ("cyrillic", "m"): ("Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Жанна", "Зоя", "Инна", "Лариса"),
    ("cyrillic", "x"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "m"): ("Άρης", "Γιάννης", "Ηλίας", "Θάνος", "Λουκάς", "Νίκος"),
    ("greek", "f"): ("Άννα", "Δανάη", "Ελένη", "Ζωή", "Ηρώ", "Μαρία"),
    ("greek", "x"): ("Άλεξ", "Χρύσα"),
}
ROOTS = {
    "latin": ("Alder", "Birk", "Corv", "Dahl", "Eskel", "Fjord", "Grun", "Holm", "Ister", "Jarn", "Kest", "Lund", "Mort", "Nord", "Ost", "Pell"),
    "cyrillic": ("Бел", "Волк", "Гром", "Дуб", "Зим", "Клён", "Лес", "Мор"),
    "greek": ("Αλεξ", "Βασιλ", "Γεωργ", "Δημητρ", "Κων", "Παπ"),
}
ENDS = {
    ("latin", ""): ("berg", "man", "ton", "sen", "wick", "ford", "mar", "stad", "by", "dale", "er", "holt", "ley", "rup", "vik", "well"),
    ("cyrillic", "m"): ("ов", "ин", "енко", "ский", "чук", "ев"),
    ("cyrillic", "f"): ("ова", "ина", "енко", "ская", "чук", "ева"),
    ("greek", ""): ("άκης", "ίδης", "όπουλος", "άτος"),
}

_NAME = r"\p{Lu}[\p{L}'-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(MALE + FEMALE + EITHER)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "card": r"(?<![\d.+-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d|[.-]\d)",
    "name": rf"\b(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}


def _joined(*names: str) -> str:
    """Patterns as one; the card's back reference is spelled out as alternatives, as numbers shift in a joint pattern."""
    card = r"(?<![\d.+-])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?!\d|[.-]\d)"
    return "|".join(card if n == "card" else PATTERNS[n] for n in names)


_STARTS = "".join(sorted({t[0] for t in MALE + FEMALE + EITHER}))
#: All entities; all but mail addresses, which can only start with a digit, a sign or a title's first letter, so that other
#: places are passed over at once; and titles alone.
ENTITY = _joined(*PATTERNS)
NO_MAIL = rf"(?=[{_STARTS}\d+(])(?:{_joined(*[n for n in PATTERNS if n != 'email'])})"
TITLED = rf"(?=[{_STARTS}])(?:{_joined('name')})"
#: Kinds of digits only, told apart by layout once a hit is known to be an entity.
_KIND = (("email", "@"), ("name", r"^\p{L}"), ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("card", r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})$"))


def kind_of(hit: Column) -> Column:
    out = F.lit("phone")
    for name, p in reversed(_KIND):
        out = F.when(hit.rlike(p), F.lit(name)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(hit: Column) -> Column:
    title = F.regexp_extract(hit, r"^[\p{L}]+", 0)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("x")


def bind(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(hit: Column, kind: Column) -> Column:
    """array<struct<kind, canon>>: what has to be replaced in a hit. A name's words are units of their own, the last one a surname."""
    code = F.regexp_extract(hit, r"^\+(\d{1,3})(?=\D)", 1)
    digits = F.regexp_replace(hit, r"\D", "")

    def phone(c: Column) -> Column:
        return bind(F.regexp_replace(hit, r"\D", ""), lambda d: F.concat(c, F.lit("-"), F.substring(d, F.length(c) + 1, F.length(d))))

    canon = F.when(kind == "email", F.lower(hit)).when(kind == "phone", bind(code, phone)).when(kind == "ip", hit).otherwise(digits)

    def words_of(words: Column) -> Column:
        def of_word(w: Column, i: Column) -> Column:
            def named(script: Column) -> Column:
                # A surname is one and the same for both genders where its ending is.
                sex = F.when((i < F.size(words) - 1) | (script == "cyrillic"), _gender(hit)).otherwise("")
                return F.struct(F.concat_ws(".", F.when(i < F.size(words) - 1, "given").otherwise("surname"), script, sex).alias("kind"), F.lower(w).alias("canon"))

            return bind(_script(w), named)

        return F.transform(words, of_word)

    words = F.split(F.regexp_replace(hit, r"^\p{L}+\.? ", ""), " ")
    return F.when(kind == "name", bind(words, words_of)).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 7


def _parts() -> Column:
    """kind of a name -> (first halves, second halves) of its surrogates."""
    both = {f"given.{script}.{sex}": [list(names), [""]] for (script, sex), names in GIVEN.items()}
    for script, roots in ROOTS.items():
        for sex in ("", "m", "f", "x"):
            both[f"surname.{script}.{sex}"] = [list(roots), list(ENDS.get((script, sex)) or ENDS.get((script, "")) or ENDS[script, "m"])]
    return F.from_json(F.lit(json.dumps(both)), "map<string,array<array<string>>>")


def _luhn(digits: Column) -> Column:
    """Sum that a valid number has at 0 modulo 10."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def surrogate(unit: Column, attempt: Column, key: str) -> Column:
    """The canonical form of a unit's replacement: a function of the unit, the key and how often it has drawn before."""
    drawn = F.struct(unit["kind"].alias("kind"), unit["canon"].alias("canon"), attempt.alias("attempt"), F.sha2(F.concat_ws("|", F.lit(key), unit["kind"], unit["canon"], attempt.cast("string")), 512).alias("h"))
    return bind(drawn, _surrogate)


def _surrogate(u: Column) -> Column:
    kind, canon, attempt, h = u["kind"], u["canon"], u["attempt"], u["h"]

    def shape(text: Column, keep: Column) -> Column:
        """Digits and letters from text's own kinds; the first `keep` characters stay."""

        def one(i: Column) -> Column:
            c = F.substring(text, i + 1, F.lit(1))
            letter = F.chr(F.lit(97) + F.pmod(_byte(h, i), F.lit(26)))
            return F.when(i < keep, c).when(c.rlike("[0-9]"), F.pmod(_byte(h, i), F.lit(10)).cast("string")).when(c.rlike("[a-z]"), letter).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")

    # A mail address keeps its top-level domain.
    email = bind(F.regexp_extract(canon, r"\.[a-z]+$", 0), lambda tld: F.concat(shape(F.substring(canon, F.lit(1), F.length(canon) - F.length(tld)), F.lit(0)), tld))
    ip = F.concat_ws(".", *[(F.pmod(_byte(h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])

    def card(body: Column) -> Column:
        def last(check: Column) -> Column:
            return F.when(_luhn(canon) % 10 == 0, check).otherwise(F.pmod(check + 1 + F.pmod(_byte(h, F.lit(60)), F.lit(9)), F.lit(10)))

        return F.concat(body, bind(F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)), last).cast("string"))

    digits = bind(shape(F.substring(canon, F.lit(1), F.length(canon) - 1), F.lit(1)), card)

    def number(i: Column) -> Column:
        return _byte(h, i * 2) * 256 + _byte(h, i * 2 + 1)

    def pick(options: Column, n: Column) -> Column:
        return F.element_at(options, F.pmod(n, F.size(options)).cast("int") + 1)

    def name(parts: Column) -> Column:
        # After some draws a name gets one more part, so there is always room.
        n = F.least(F.lit(8), F.when(F.startswith(kind, F.lit("given")), F.floor(attempt / 2)).otherwise(F.floor(attempt / 4)) + 1).cast("int")
        joined = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(pick(parts[0], number(i * 2)), pick(parts[1], number(i * 2 + 1)))), "-")
        return F.lower(F.concat_ws("-", joined, F.when(attempt >= 24, attempt.cast("string"))))

    named = bind(F.element_at(_parts(), kind), name)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", digits).when(kind == "phone", shape(canon, F.instr(canon, "-"))).when(kind == "ssn", shape(canon, F.lit(0))).otherwise(named)


def render(hit: Column, kind: Column, replaced: Column) -> Column:
    """hit rewritten with the surrogates of its units (array<string>), in the layout and letter case of hit."""
    each = F.sequence(F.lit(1), F.length(hit))

    def laid(digits: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.length(F.regexp_replace(F.substring(hit, F.lit(1), i), r"\D", ""))
            return bind(F.substring(hit, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), F.substring(digits, at, F.lit(1))).otherwise(c))

        return F.array_join(F.transform(each, one), "")

    def cased(one: Column) -> Column:
        return F.array_join(F.transform(each, lambda i: F.when(F.substring(hit, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(one, i, F.lit(1)))).otherwise(F.substring(one, i, F.lit(1)))), "")

    title = F.regexp_extract(hit, r"^\p{L}+\.? ", 0)
    words = F.split(F.regexp_replace(hit, r"^\p{L}+\.? ", ""), " ")
    named = F.array_join(F.zip_with(words, replaced, lambda w, r: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(r)).otherwise(F.array_join(F.transform(F.split(r, "-"), lambda p: F.initcap(p)), "-"))), " ")
    return F.when(kind == "email", bind(replaced[0], cased)).when(kind == "name", F.concat(title, named)).when(kind == "ip", replaced[0]).otherwise(bind(F.regexp_replace(replaced[0], r"\D", ""), laid))


def with_hits(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and their hits in order; gaps, the text between them, if there are any.

    Cheap tests come first: most texts have neither a digit nor a title nor a mail address, and are not searched further.
    """
    text = F.col("text")
    mail = F.contains(text, F.lit("@"))
    other = text.rlike("[0-9]") | text.rlike(TITLED)
    hits = F.when(mail, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).when(other, F.regexp_extract_all(text, F.lit(NO_MAIL), F.lit(0)))
    gaps = F.when(mail, F.split(text, ENTITY, -1)).when(other, F.split(text, NO_MAIL, -1))
    found = docs.withColumn("hits", F.coalesce(hits, F.array().cast("array<string>")))
    return found.withColumn("gaps", F.when(F.size("hits") > 0, gaps))


def drawn_again(found: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, canon, attempt > 0) of the distinct units (kind, canon) that may not keep their first surrogate."""
    real = cut(found.where("canon IS NOT NULL").distinct())
    state = real.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        named = state.withColumn("s", surrogate(F.struct("kind", "canon"), F.col("attempt"), key))
        shared = named.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("kind").alias("k1"), F.col("s").alias("s1"), "first")
        taken = real.select(F.col("kind").alias("k2"), F.col("canon").alias("s2"), F.lit(True).alias("taken"))
        j = named.join(shared, (named["kind"] == shared["k1"]) & (named["s"] == shared["s1"]), "left").join(taken, (named["kind"] == taken["k2"]) & (named["s"] == taken["s2"]), "left")
        clash = F.coalesce("taken", F.lit(False)) | (F.col("first").isNotNull() & (F.col("first.canon") != F.col("canon")))
        checked = cut(j.select("kind", "canon", "attempt", clash.alias("clash")))
        if checked.where("clash").isEmpty():
            return checked.where("attempt > 0").drop("clash")
        state = checked.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise RuntimeError("more entities of a kind than there are surrogates")


def replace_pii(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text with surrogates, entities: array of kinds in order), a row for each row of docs."""
    d = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"))
    kinds = F.transform("hits", lambda x: F.struct(x.alias("hit"), kind_of(x).alias("kind")))
    found = with_hits(d).select("id", "row", F.explode(kinds).alias("x")).select("id", "row", F.explode(units(F.col("x.hit"), F.col("x.kind"))).alias("u")).select("id", "row", "u.kind", "u.canon")
    again = drawn_again(found.select("kind", "canon"), key)
    if again.isEmpty():
        work = d.withColumn("again", F.lit(None).cast("map<string,int>"))
    else:
        of_doc = found.distinct().join(again, ["kind", "canon"]).groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("again")).withColumnsRenamed({"id": "a_id", "row": "a_row"})
        work = d.join(of_doc, d["id"].eqNullSafe(of_doc["a_id"]) & (d["row"] == of_doc["a_row"]), "left").select("id", "row", "text", "again")

    def replaced(x: Column) -> Column:
        def one(u: Column) -> Column:
            attempt = F.coalesce(F.try_element_at("again", F.concat_ws("|", u["kind"], u["canon"])), F.lit(0))
            return surrogate(u, attempt, key)

        return F.struct(x["hit"].alias("hit"), x["kind"].alias("kind"), F.transform(units(x["hit"], x["kind"]), one).alias("new"))

    work = with_hits(work).withColumn("hits", F.when(F.size("hits") > 0, F.transform(kinds, replaced)))
    new = F.array_join(F.zip_with("gaps", "hits", lambda g, x: F.concat(g, F.when(x.isNull(), "").otherwise(render(x["hit"], x["kind"], x["new"])))), "")
    return work.select(F.col("id").alias("doc_id"), F.when(F.col("hits").isNull(), F.col("text")).otherwise(new).alias("text"), F.coalesce(F.transform("hits", lambda x: x["kind"]), F.array().cast("array<string>")).alias("entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates-1")
    return d.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join("entities", ",").alias("entities"), "text")
