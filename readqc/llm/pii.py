"""Personal data: detection and surrogate generation in DataFrame operations only.

One pattern finds e-mail addresses, card numbers, phone numbers (with country code, or local in usual formats), IPv4 and
IPv6 addresses, access keys, IBAN, social security numbers (3-2-4 digits), assigned secrets and names after a form of
address. A surrogate is a keyed function of (type, entity, attempt): letters become letters of the same case and script,
digits digits, all else stays, so the format is kept; card numbers keep their first digit and whether they pass the Luhn
test, IBAN their country and whether their check digits hold, phone numbers their country code, IPv4 octets stay in range,
and given names come from a list of the gender that the form of address tells. The same entity gets the same surrogate
everywhere, without a join; spellings of one card or phone number (separators), IBAN (spaces), e-mail or IPv6 address (case)
are one entity, and their surrogates agree likewise.

A name has two parts with surrogates of their own, the family name and the given names within a family, so "Mr Smith" and
"Mr John Smith" stay linked; where a document goes on with "John Smith", "J. Smith", "Smith", "SMITH" or "John", these are
replaced as well, in one pass over the text as it was, but for parts of names that are words (WORDS).

Distinctness: surrogates of all distinct parts are counted; parts that share one, or whose surrogate is itself a part of
the corpus, try again with the next attempt until none is left. From the fourth attempt on surrogates of names, addresses
and phone numbers grow longer, so a crowded format does not run out. These exceptions, and only they, are joined back, as
a small map for each document that holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

OUT = ["entities", "surrogates", "clean_text"]
KINDS = ("email", "card", "phone", "ip", "key", "iban", "ipv6", "ssn", "secret", "name")

# Forms of address by gender, and given names by gender and script.
FEMALE_FORMS = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Госпожа")
MALE_FORMS = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин")
FEMALE = {"latin": ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"), "cyrillic": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София")}
MALE = {"latin": ("Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Lucas", "Martin", "Oscar", "Simon"), "cyrillic": ("Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел")}

# Words that are names as well. A plain mention of such a name alone is taken for the word.
WORDS = (
    "able", "april", "august", "baker", "bell", "best", "bishop", "black", "brown", "bush", "carpenter", "church", "cook", "cross", "day", "english", "faith", "field", "fish", "fox", "french", "good", "grace", "gray", "green", "grey", "hall", "hill", "hope", "house", "hunter", "july", "june", "king", "lake",
    "law", "little", "long", "major", "march", "mark", "may", "mercy", "miller", "moon", "north", "page", "park", "pope", "price", "prince", "read", "rice", "rich", "river", "rose", "short", "small", "smart", "stone", "strong", "summer", "sun", "sunday", "west", "white", "will", "winter", "wise", "wolf", "wood", "young",
    "berg", "fuchs", "gross", "klein", "koch", "kurz", "lang", "richter", "schwarz", "stark", "weiss", "winkler", "blanc", "bon", "grand", "leroy", "marchand", "petit", "blanco", "bueno", "calle", "casa", "iglesias", "leon", "rey", "rubio",
)

_FORMS = "|".join(sorted((*FEMALE_FORMS, *MALE_FORMS), key=lambda x: (-len(x), x)))
# A name has further capitalised parts, initials, hyphens and apostrophes; "'s" is left out. Possessive loops need no stack.
_PART = r"(?:\p{Lu}\. ?)*+\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?=\p{L}{2}))++"
_PREFIX = r"(?:password|passwd|secret|api_key|token)(?: = \"|=\"|: \"|=|: )"
#: Each begins where no word character, dot, %, + or - comes before.
PATTERNS = {
    "email": r"[A-Za-z0-9_%+][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "card": r"[3-6]\d{3}(?:[ -]?\d{4}){3}(?![\w-])",
    "phone": r"(?:\+\d{1,3} ?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}|\((?:0\d{1,4}|\d{3})\) ?\d{3,4}[ -]?\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)",
    "key": r"AKIA[A-Z0-9]{16}(?!\w)",
    "iban": r"(?=[A-Z]{2}\d{2}(?: ?[A-Z]{0,4} ?\d){7})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])",
    "ipv6": r"(?=[A-Fa-f]{0,3}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?!\w|:\w)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "secret": _PREFIX + r"[A-Za-z0-9_+/-]{12,}+",
    "name": rf"(?:{_FORMS})\.? {_PART}(?: {_PART})*+",
}
ANY = r"(?<![\w.%+-])(?:" + "|".join(PATTERNS[k] for k in KINDS) + ")"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def kind_of(e: Column) -> Column:
    """Type of an entity, told by its format alone."""
    out = F.when(e.contains("@"), "email").when(e.rlike(r"^(\+|\(|\d{3}-\d{3}-)"), "phone").when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
    out = out.when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6").when(e.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
    return out.when(e.rlike(r"^[3-6]\d{3}([ -]?\d{4}){3}$"), "card").when(e.rlike("^AKIA[A-Z0-9]{16}$"), "key").when(e.rlike(rf"^({_FORMS})\.? "), "name").otherwise("secret")


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def canonical(kind: Column, e: Column) -> Column:
    """What the spellings of an entity have in common: digits of a card or phone number, an IBAN without spaces, an e-mail or IPv6 address without case, a secret without what introduces it."""
    out = F.when(kind.isin("card", "phone"), _digits(e)).when(kind.isin("email", "ipv6"), F.lower(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
    return out.when(kind == "secret", F.regexp_replace(e, f"^{_PREFIX}", "")).otherwise(e)


def _stream(key: str, kind: Column, e: Column, attempt: Column) -> Column:
    """512 keyed hex digits."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, e, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 512) for i in range(4)])


def _number(h: Column, i: Column, n: Column | int) -> Column:
    """Number below n from three hex digits of the stream at position i."""
    at = (i * 3) % 507 + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(3)), 16, 10).cast("int") % n


def _shuffled(e: Column, h: Column) -> Column:
    """Each letter and digit replaced by one of its class."""

    def one(c, i, hexes):
        i = i + 1
        hexed = hexes & c.rlike("[a-f]")
        pick = lambda letters: F.substr(F.lit(letters), _number(h, i, len(letters)) + 1, F.lit(1))
        out = F.when(c.rlike("[0-9]"), pick("0123456789")).when(hexed, pick("abcdef")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out = out.when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), pick(_CYRILLIC)).when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), pick(_CYRILLIC.upper()))
        return out.when(c.rlike(r"\p{Ll}"), pick("àâäçèéêëìíîïñòóôöùúûü")).when(c.rlike(r"\p{Lu}"), pick("ÀÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ")).otherwise(c)

    return _once(e.rlike("^[0-9a-f]{12,}+$"), lambda hexes: F.array_join(F.transform(F.split(e, ""), lambda c, i: one(c, i, hexes)), ""))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    def add(total, i):
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.floor(d * 2 / 10).cast("int") + d * 2 % 10)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)


def _placed(e: Column, digits: Column) -> Column:
    """e with its digits replaced by these, in order."""
    place = lambda i: F.char_length(_digits(F.substr(e, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(e)), lambda i: F.when(F.substr(e, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, place(i), F.lit(1))).otherwise(F.substr(e, i, F.lit(1)))), "")


def _card(e: Column, h: Column) -> Column:
    """First digit, separators and the outcome of the Luhn test are kept."""
    digits = _digits(e)
    new = _shuffled(digits, h)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.substr(new, F.lit(2), F.lit(14)))
    good = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    last = F.when(luhn_sum(digits) % 10 == 0, good).otherwise((good + 1 + _number(h, F.lit(90), 9)) % 10)
    return _once(F.concat(body, last.cast("string")), lambda full: _placed(e, full))


def _phone(e: Column, h: Column) -> Column:
    """Country code and separators are kept. The code is told by the digits alone: 1 and 7, those of two digits, or three digits."""
    digits = _digits(e)
    code = F.regexp_extract(digits, r"^([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 1)
    return _once(F.concat(code, F.substr(_shuffled(digits, h), F.char_length(code) + 1)), lambda full: _placed(e, full))


def iban_rest(e: Column) -> Column:
    """An IBAN without spaces, its first four characters last, letters as 10 to 35, modulo 97: 1 if its check digits hold."""
    moved = F.concat(F.substr(e, F.lit(5)), F.substr(e, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _iban(e: Column, h: Column) -> Column:
    """Country, spaces and whether the check digits hold are kept."""
    bare = F.replace(e, F.lit(" "), F.lit(""))
    country = F.substr(bare, F.lit(1), F.lit(2))

    def checked(body):
        good = 98 - iban_rest(F.concat(country, F.lit("00"), body))  # 2 to 98
        other = (good - 1 + _number(h, F.lit(90), 96)) % 97 + 2
        return F.concat(country, F.lpad(F.when(iban_rest(bare) == 1, good).otherwise(other).cast("string"), 2, "0"), body)

    at = lambda full, i: F.substr(full, F.char_length(F.replace(F.substr(e, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1))
    spaced = lambda full: F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(e)), lambda i: F.when(F.substr(e, i, F.lit(1)) == " ", " ").otherwise(at(full, i))), "")
    return _once(_once(_shuffled(F.substr(bare, F.lit(5)), h), checked), spaced)


def _ipv6(e: Column, h: Column) -> Column:
    """Hex digits and letters of either case are replaced by their like, so colons and groups are kept."""

    def one(c, i):
        pick = lambda letters: F.substr(F.lit(letters), _number(h, i, len(letters)) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-f]"), pick("abcdef")).when(c.rlike("[A-F]"), pick("ABCDEF")).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _form(e: Column) -> Column:
    return F.regexp_extract(e, rf"^({_FORMS})\.? ", 0)


def _family(name: Column) -> Column:
    """The last word of a name without form of address."""
    return F.regexp_extract(name, r"([^ .]+)$", 1)


def _gender(form: Column) -> Column:
    return F.when(form.rlike(f"^({'|'.join(FEMALE_FORMS)})\\W"), "f").otherwise("m")


def _given(c: Column, given: Column, h: Column, attempt: Column) -> Column:
    """Given names: the first from the list of its gender and script, unless it is an initial; others keep script, length and capitals. One more name of the list for every four attempts."""

    def of(lists, script, i):
        return F.element_at(F.array(*map(F.lit, lists[script])), _number(h, i, len(lists[script])) + 1)

    cyrillic, female = given.rlike(r"^\p{IsCyrillic}"), c.startswith("f|")
    first = lambda i: F.when(female, F.when(cyrillic, of(FEMALE, "cyrillic", i)).otherwise(of(FEMALE, "latin", i))).otherwise(F.when(cyrillic, of(MALE, "cyrillic", i)).otherwise(of(MALE, "latin", i)))
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 4).cast("int")), lambda i: first(i + 70)), " ")
    new = _shuffled(given, h)
    return F.when(given.rlike(r"^\p{Lu}\."), F.concat(F.when(attempt >= 4, F.concat(names, F.lit(" "))).otherwise(""), new)).otherwise(F.regexp_replace(new, F.lit("^[^ ]+"), names))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _longer(text: Column, h: Column, attempt: Column, letters: str) -> Column:
    """text, and from the fourth attempt on a further letter for every two."""
    more = F.greatest(F.floor((attempt - 2) / 2), F.lit(0)).cast("int")
    return F.concat(text, F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.substr(F.lit(letters), _number(h, i + 110, len(letters)) + 1, F.lit(1))), "")).otherwise(""))


def value(key: str, kind: Column, c: Column, e: Column, attempt: Column) -> Column:
    """The surrogate of a part (kind, canonical form c) in the spelling e. Kinds family and given are parts of names; c of given is gender|family|given names."""

    def made(h):
        new = lambda: _shuffled(e, h)
        ip = F.array_join(F.transform(F.split(e, r"\."), lambda x, i: (_number(h, i + 100, 254) + 1).cast("string")), ".")
        local = _longer(F.regexp_extract(new(), "^[^@]*", 0), h, attempt, "abcdefghijklmnopqrstuvwxyz")
        host = F.concat(local, F.regexp_extract(new(), r"(@.*?)[^.]*$", 1), F.regexp_extract(e, r"([^.]*)$", 1))
        out = F.when(kind == "ip", ip).when(kind == "email", host).when(kind == "phone", _longer(_phone(e, h), h, attempt, "0123456789"))
        out = out.when(kind == "card", _card(e, h)).when(kind == "key", F.concat(F.lit("AKIA"), F.substr(new(), F.lit(5))))
        out = out.when(kind == "iban", _iban(e, h)).when(kind == "ipv6", _ipv6(e, h))
        last = F.when(e.rlike(r"\p{IsCyrillic}$"), _longer(new(), h, attempt, _CYRILLIC)).otherwise(_longer(new(), h, attempt, "abcdefghijklmnopqrstuvwxyz"))
        out = out.when(kind == "family", last).when(kind == "given", _given(c, e, h, attempt))
        prefix = F.regexp_extract(e, f"^{_PREFIX}", 0)
        return out.otherwise(F.concat(prefix, _shuffled(F.substr(e, F.char_length(prefix) + 1), h)))

    return _once(_stream(key, kind, c, attempt), made)


def parts(e: Column) -> Column:
    """array<struct<kind, c, e>>: the parts of an entity. A name has its family name and, if there are, its given names."""

    def of_name(bare):
        family = _family(bare)
        given = F.rtrim(F.substr(bare, F.lit(1), F.char_length(bare) - F.char_length(family)))
        both = F.struct(F.lit("given").alias("kind"), F.concat_ws("|", _gender(_form(e)), family, given).alias("c"), given.alias("e"))
        only = F.struct(F.lit("family").alias("kind"), family.alias("c"), family.alias("e"))
        return F.when(given != "", F.array(only, both)).otherwise(F.array(only))

    name = lambda: _once(F.substr(e, F.char_length(_form(e)) + 1), of_name)
    return _once(kind_of(e), lambda kind: F.when(kind == "name", name()).otherwise(F.array(F.struct(kind.alias("kind"), canonical(kind, e).alias("c"), e.alias("e")))))


def _label(part: Column) -> Column:
    return F.concat_ws(":", part["kind"], part["c"])


def surrogate(key: str, e: Column, odd: Column | None = None) -> Column:
    """The surrogate of an entity; odd: map from part to attempt, where it isn't 0."""

    def joined(ps):
        attempt = lambda p: F.lit(0) if odd is None else F.coalesce(F.element_at(odd, _label(p)), F.lit(0))
        new = F.transform(ps, lambda p: value(key, p["kind"], p["c"], p["e"], attempt(p)))

        def named(v):
            bare = F.substr(e, F.char_length(_form(e)) + 1)
            gap = F.when(F.size(v) > 1, F.regexp_extract(bare, r"( *)[^ .]+$", 1)).otherwise("")
            return F.concat(_form(e), F.when(F.size(v) > 1, F.element_at(v, 2)).otherwise(""), gap, F.element_at(v, 1))

        return _once(new, lambda v: F.when(F.element_at(ps, 1)["kind"] == "family", named(v)).otherwise(F.element_at(v, 1)))

    return _once(parts(e), joined)


def found_in(text: Column) -> Column:
    """The entities of a text in order."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), F.array().cast("array<string>"))


def exceptions(entities: DataFrame, key: str, attempts: int = 60) -> DataFrame:
    """(part, attempt): the parts, of a table of entities (e), whose first surrogate would not be distinct, with the attempt of one that is."""
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = entities.select(F.explode(parts(F.col("e"))).alias("p")).select("p.kind", "p.c", _label(F.col("p")).alias("part")).distinct()
    held = stored(held.repartition(n, "part"), "parts")

    def made(table, attempt):
        """What must be distinct: the surrogate of the canonical form, for given names that of their family."""
        spelt = F.when(F.col("kind") == "given", F.element_at(F.split("c", r"\|"), 3)).otherwise(F.col("c"))
        before = F.when(F.col("kind") == "given", F.regexp_extract("c", r"^[^|]*\|[^|]*\|", 0)).otherwise("")
        s = F.concat(F.col("kind"), F.lit(":"), before, value(key, F.col("kind"), F.col("c"), spelt, F.lit(attempt)))
        return table.select("kind", "c", "part", F.lit(attempt).alias("attempt"), s.alias("s"))

    table = stored(made(held, 0), "surrogates")
    for attempt in range(1, attempts + 1):
        shared = table.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "part")).alias("first")).filter("n > 1").select("s", F.col("first.part").alias("first"))
        bad = table.join(shared, "s").filter("part <> first").select("kind", "c", "part").union(table.join(held.select(F.col("part").alias("s")), "s", "left_semi").select("kind", "c", "part")).distinct()
        bad = stored(bad.repartition(n, "part"), "again")
        if bad.isEmpty():
            return table.filter("attempt > 0").select("part", "attempt")
        table = stored(table.join(bad, "part", "left_anti").unionByName(made(bad, attempt)), "surrogates")
    raise RuntimeError(f"surrogates still collide after {attempts} attempts")


def _mentions(text: Column, names: Column) -> Column:
    """text with plain mentions of names (array<struct<bare, new>>, longest first) replaced, as whole words and in one pass, so what replaces a name is not read again."""

    def replaced(pattern):
        new = lambda m: F.element_at(F.filter(names, lambda n: n["bare"] == m), 1)["new"]
        met = F.regexp_extract_all(text, pattern, F.lit(0))
        return F.array_join(F.zip_with(F.split(text, pattern, -1), met, lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(new(m)))), "")

    any_of = F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n["bare"], F.lit(r"\E"))), "|")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), any_of, F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.exists(names, lambda n: F.instr(text, n["bare"]) > 0), _once(whole, replaced)).otherwise(text)


def _plain_names(entities: Column, surrogates: Column) -> Column:
    """array<struct<bare, new>>, longest first: how a document may go on with the names of its entities, in full, by initial and family name, by family name, also in capitals, or by given names; of two surrogates of one spelling the first."""
    bare = lambda e: F.substr(e, F.char_length(_form(e)) + 1)
    given = lambda name: F.rtrim(F.substr(name, F.lit(1), F.char_length(name) - F.char_length(_family(name))))
    named = F.filter(F.arrays_zip(entities.alias("e"), surrogates.alias("s")), lambda x: x["e"].rlike(rf"^({_FORMS})\.? "))
    pair = lambda old, new: F.struct(old.alias("bare"), new.alias("new"))
    whole = F.transform(named, lambda x: pair(bare(x["e"]), bare(x["s"])))
    part = lambda of: F.filter(F.transform(whole, lambda n: pair(of(n["bare"]), of(n["new"]))), lambda n: (n["bare"] != "") & ~n["bare"].rlike(r"\.$") & ~F.lower(n["bare"]).isin(*WORDS))
    initial = lambda name: F.when(given(name) != "", F.concat(F.substr(name, F.lit(1), F.lit(1)), F.lit(". "), _family(name))).otherwise("")
    loud = lambda name: F.when(F.char_length(_family(name)) > 2, F.upper(_family(name))).otherwise("")
    longest = lambda a, b: F.char_length(b["bare"]) - F.char_length(a["bare"])
    return F.array_sort(F.array_distinct(F.concat(F.filter(whole, lambda n: n["bare"].contains(" ")), part(_family), part(given), part(initial), part(loud))), longest)


def anonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs plus entities, surrogates (arrays in order) and clean_text. key: the secret that surrogates depend on.

    A null text has no entities and stays null. Rows may share an id; rows without id are treated alike. Equal entities have
    equal surrogates in all rows, different ones different surrogates, and no surrogate is an entity of the table. Names that
    no form of address introduces anywhere in a document are not found. Two spellings of an IPv6 address that differ in more
    than case are two entities. Columns named like an added one are replaced; others may have any
    name.
    """
    docs = docs.drop(*OUT)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    held = stored(rows.select("id", F.explode(F.array_distinct(found_in(F.col("text")))).alias("e")), "entities")
    odd = stored(exceptions(held.select("e").distinct(), key), "exceptions")
    out = rows.withColumn("entities", found_in(F.col("text"))).withColumn("pieces", F.split("text", ANY, -1))
    if odd.isEmpty():
        out = out.withColumn("surrogates", F.transform("entities", lambda e: surrogate(key, e)))
    else:
        met = held.select("id", F.explode(F.transform(parts(F.col("e")), _label)).alias("part")).distinct().join(odd, "part")
        maps = met.groupBy(F.col("id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias("odd"))
        out = out.join(maps, F.col("id").eqNullSafe(F.col("of")), "left")
        out = out.withColumn("surrogates", F.transform("entities", lambda e: surrogate(key, e, F.coalesce(F.col("odd"), F.create_map().cast("map<string,int>")))))
    out = out.withColumn("names", _plain_names(F.col("entities"), F.col("surrogates")))
    out = out.withColumn("pieces", F.when(F.size("names") > 0, F.transform("pieces", lambda p: _mentions(p, F.col("names")))).otherwise(F.col("pieces")))
    joined = F.array_join(F.zip_with("pieces", "surrogates", lambda piece, s: F.concat(piece, F.coalesce(s, F.lit("")))), "")
    clean = F.when(F.size("entities") == 0, F.col("text")).otherwise(joined)
    new = F.struct("entities", "surrogates", clean.alias("clean_text"))
    return out.select("row", new.alias("new")).select("row.*", "new.*")


def summary(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, entities of each kind and in all, and the SHA-256 of the surrogates and of the rewritten text."""
    out = anonymise(docs.select("doc_id", "text"), key)
    kinds = F.transform("entities", kind_of)
    counts = [F.size(F.array_remove(kinds, name)).alias(name) for name in KINDS]
    counts = [(F.size("entities") - c).cast("long").alias(f"n_{name}") for c, name in zip(counts, KINDS, strict=True)]
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *counts, F.sha2(F.array_join("surrogates", "\n"), 256).alias("surrogates_sha256"), F.sha2("clean_text", 256).alias("clean_sha256"))
