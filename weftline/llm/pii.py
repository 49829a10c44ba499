"""Personal data in text replaced by keyed surrogates, with built-in column functions only.

Entities are e-mail addresses, IPv4 and IPv6 addresses, IBANs, payment card
numbers, US social security numbers, telephone numbers, names after a title, and
further mentions of those names in the same text. Each is reduced to its symbols
(letters, digits or octets). A keyed Feistel network, whose rounds add, symbol by
symbol, a digest of the other half modulo the size of the symbol's class, maps
them to others; one symbol is moved on by one there, and the network is run
backwards. The result is a bijection on each shape without fixed points: it has
the type, script, case, length and punctuation of what it replaces, different
entities stay different, mentions of one entity (whatever their case or
punctuation) stay the same, and none stays what it was. Further rules:

* cards keep their first digit and whether the Luhn check holds, IBANs their
  country and the remainder of their check;
* telephone numbers keep a leading + and country code;
* e-mail addresses keep their dots and top-level domain;
* a name is one or more titles and any number of words, initials and particles
  (van, de la), ending in a word; particles stay. A title in capitals counts
  before a word in capitals, and a word in capitals is the same name's;
* a listed given name is permuted within the list of its gender and script,
  whatever the title, so Dr and Mrs Anna Roe are one person; other words go
  letter by letter among vowels and among consonants, or within their script. A
  last word, or one alone, has one surrogate wherever it stands, listed or not;
* the words of a name have their surrogates wherever they follow each other in a
  text that holds the name with a title, its last word also alone, but for words
  of COMMON at the start of a sentence.

``surrogates`` lists entities with their replacements and checks that no two
entities of a type share one; ``replace`` refuses to go on if any do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

ROUNDS = 4

# Titles and frequent given names, by gender.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "Госпожа", "Κυρία"],
    "n": ["Dr", "Dra", "Prof", "Doctor", "Professor"],
}
NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Peter Paul Hans Karl Stefan Jürgen Jean Pierre Michel Louis José Juan Carlos Luis",
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Maria Ursula Sabine Petra Monika Marie Sophie Claire Julie Carmen Lucía Elena Isabel",
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия",
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Γιάννης Κώστας Παναγιώτης",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική",
}
#: Small words within names; they stay as they are.
PARTICLES = "van von vom der den de het la las los del della di da do dos das du le ten ter zu zum zur af av bin ibn al el y"
#: Family names that also begin sentences as plain words; alone and there they stay.
COMMON = (
    "Will May Can Must Might Day Long Short Young Old Good Best Rich Small Little Great High Low Hope Love Rose Grace Major Frank Mark Bill Grant Chase Miles Page Price Case "
    "King Knight Bishop Pope Church Hall Hill Wood Woods Stone Field Fields Brook Brooks Banks Bush Green Brown White Black Gray Grey Gold Silver Winter Summer Snow Rain Frost "
    "North South East West Sharp Strong Swift Wise Noble Moody Savage Power Self Still Ward Wells Young Klein Gross Lange Kurz Weiß Schwarz Braun Groß Jung Alt"
)

#: Classes of characters that are permuted among themselves.
LETTERS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "ąęěůűőāēīōūėįųćčďđğłńňřśşšťźżžĺľŕșțģķļņ",
    "ĄĘĚŮŰŐĀĒĪŌŪĖĮŲĆČĎĐĞŁŃŇŘŚŞŠŤŹŻŽĹĽŔȘȚĢĶĻŅ",
    "ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹơưă",
    "ẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸƠƯĂ",
    "άέήίόύώϊϋ",
    "ΆΈΉΊΌΎΏΪΫ",
    "іїєґўђјљњћџ",
    "ІЇЄҐЎЂЈЉЊЋЏ",
]
SOUNDS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñýÿ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ", "ÇÑÝ",
    "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "АЕИОУЫЭЮЯЁ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "ąęěůűőāēīōūėįų", "ćčďđğłńňřśşšťźżžĺľŕșțģķļņ", "ĄĘĚŮŰŐĀĒĪŌŪĖĮŲ", "ĆČĎĐĞŁŃŇŘŚŞŠŤŹŻŽĹĽŔȘȚĢĶĻŅ", *LETTERS[11:],
]
#: First and last code points of scripts whose letters are permuted among themselves.
SCRIPTS = [
    (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0531, 0x0556), (0x0561, 0x0586), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10FA),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Country codes of one and two digits; the others have three.
_CODES = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_CAPITALS = "|".join(t.upper() for g in TITLES.values() for t in g)
_TITLED = rf"(?:(?:(?:{_TITLE})\.? )+|(?:(?:{_CAPITALS})\.? )+(?=\p{{Lu}}[\p{{Lu}}.'’-]*(?!\p{{L}})))"
_HEX = "[0-9A-Fa-f]{1,4}"
_WORD = r"\p{Lu}[\p{L}'’-]+|[\p{Lo}][\p{Lo}'’-]+"
_INITIAL = r"\p{Lu}(?:\.-?\p{Lu})*+\.?"
_PARTICLE = "|".join(PARTICLES.split())
_LEAD = rf"(?:(?:{_PARTICLE}) )*+"
_TOP = r"\.(?:[xX][nN]--[A-Za-z0-9-]+|\p{L}{2,})"
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*" + _TOP,
    "ipv4": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|{_HEX}:(?::{_HEX}){{2,6}})(?![0-9A-Za-z:]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}(?:0[2-9]|[1-8][0-9]|9[0-8])(?=(?: ?[A-Z0-9])*? ?[0-9])(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[2-6](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<=[0-9][ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,3}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"
    # + and 7 to 15 digits, together or apart; national numbers with a leading 0, by spaces
    r"|(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{6,14}|\+[1-9](?:[ ./-]?\(?[0-9]\)?){6,14}|(?=(?:[0-9] ?){7,15}(?![0-9]))0[0-9]{1,4}(?: [0-9]{2,8}){1,4}|(?=(?:[0-9][ /-]?){7,15}(?![0-9]))0[0-9]{2,4}[/-][0-9]{2,8}(?:[ /-][0-9]{2,8}){0,3})(?![0-9A-Za-z])",
    # groups that never give back what they took: names of any length need no recursion
    "name": rf"(?<![\p{{L}}]){_TITLED}(?:(?:{_PARTICLE}|{_INITIAL}) )*+(?:{_WORD})(?: (?:(?:{_PARTICLE}|{_INITIAL}) )*+(?:{_WORD}))*+",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
WORDS = rf"{ENTITY}|(?<![\p{{L}}]){_LEAD}(?:{_WORD}|{_INITIAL}(?= ))"
#: The end of what comes before the first word of a sentence.
_BEFORE = r"(?:[.!?…][\"'”’»)]*\s+|\n\s*)[\"'“‘„«(¿¡]*$"
_MARK = "\u0001"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _place(c: Column, classes: list[str]) -> Column:
    """struct(v, first, size, kind, c) of a character: its place in its class, a list (kind 1) or a script (2); kind 0 is of none."""
    starts = [len("".join(classes[:i])) for i in range(len(classes))]
    scripts = sorted(SCRIPTS) if len(classes) > 1 else []

    def within(place: Column, firsts: list[int], sizes: list[int], kind: int) -> Column:
        # the last class that begins at or before the place
        k = F.size(F.filter(F.lit(firsts), lambda f: f <= place)) - 1
        return _let(k, lambda i: F.struct((place - F.get(F.lit(firsts), i)).cast("int").alias("v"), F.get(F.lit(firsts), i).alias("first"), F.get(F.lit(sizes), i).alias("size"), F.lit(kind).alias("kind"), c.alias("c")))

    at, code = F.instr(F.lit("".join(classes)), c) - 1, F.ascii(c)
    out = F.when(at >= 0, within(at, starts, [len(x) for x in classes], 1))
    if scripts:
        own = within(code, [a for a, _ in scripts], [b - a + 1 for a, b in scripts], 2)
        out = out.when((code >= scripts[0][0]) & (own["v"] < own["size"]), own)
    return out.otherwise(F.struct(F.lit(0).alias("v"), F.lit(0).alias("first"), F.lit(1).alias("size"), F.lit(0).alias("kind"), c.alias("c")))


def _feistel(symbols: Column, key: Column, back: bool = False) -> Column:
    """Permute array<struct<v, size, ...>>: v is changed within its size, everything else stays; ``back`` gives the inverse.

    Each round replaces (left, right) by (right, left + digest of right); after an even number of rounds both are back in place.
    """

    def step(state: Column, n: Column) -> Column:
        still, moved = (state["a"], state["b"]) if back else (state["b"], state["a"])
        seen = F.array_join(F.transform(still, lambda s: s["v"].cast("string")), ",")
        digest = F.sha2(F.concat_ws("|", key, n.cast("string"), F.size(moved).cast("string"), seen).cast("binary"), 256)

        def add(hex_: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                more = F.conv(F.substring(hex_, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
                return s.withField("v", F.pmod(s["v"] - more if back else s["v"] + more, s["size"]).cast("int"))

            return F.transform(moved, one)

        new = _let(digest, add)
        return F.struct(new.alias("a"), still.alias("b")) if back else F.struct(still.alias("a"), new.alias("b"))

    def halves(own: Column) -> Column:
        h = F.floor(F.size(own) / 2).cast("int")
        return F.struct(F.slice(own, F.lit(1), h).alias("a"), F.slice(own, h + 1, F.size(own) - h).alias("b"))

    rounds = F.array(*map(F.lit, reversed(range(ROUNDS)) if back else range(ROUNDS)))
    return F.aggregate(rounds, _let(symbols, halves), step, lambda s: F.concat(s["a"], s["b"]))


def _moved(symbols: Column, key: Column) -> Column:
    """A permutation without fixed points: there by the network, one step on in the first symbol that has others in its class, and back."""

    def on(own: Column) -> Column:
        first = F.array_position(F.transform(own, lambda s: s["size"] > 1), True) - 1
        return F.transform(own, lambda s, i: F.when(i == first, s.withField("v", F.pmod(s["v"] + 1, s["size"]).cast("int"))).otherwise(s))

    return _feistel(_let(_feistel(symbols, key), on), key, back=True)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permuted(text: Column, key: Column, classes: list[str]) -> Column:
    """The text with its characters permuted within their classes; characters of none stay, and key the rest."""
    joined = F.lit("".join(classes))

    def mixed(places: Column) -> Column:
        fixed = F.array_join(F.transform(places, lambda s: F.when(s["kind"] > 0, ".").otherwise(s["c"])), "")
        return _moved(places, F.concat_ws("|", key, fixed))

    def spelled(s: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.hex(s["first"] + s["v"]), 4, "0")), "UTF-16BE")
        return F.when(s["kind"] == 1, F.substring(joined, s["first"] + s["v"] + 1, F.lit(1))).when(s["kind"] == 2, code).otherwise(s["c"])

    return F.array_join(F.transform(_let(F.transform(_characters(text), lambda c: _place(c, classes)), mixed), spelled), "")


def _recased(new: Column, like: Column) -> Column:
    """``new`` (lower case) with capitals where ``like`` has them."""
    return F.array_join(F.zip_with(_characters(new), _characters(like), lambda n, o: F.when(o != F.lower(o), F.upper(n)).otherwise(n)), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(text: Column, digits: Column, what: str = "[0-9]") -> Column:
    """``text`` with its digits (or ``what``) replaced, in order, by ``digits``."""

    def fill(own: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            digit = c.rlike(what)
            return F.struct((state["n"] + digit.cast("int")).alias("n"), F.concat(state["out"], F.when(digit, F.substring(own, state["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(_characters(text), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda s: s["out"])

    return _let(digits, fill)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    values = F.transform(_characters(F.reverse(digits)), lambda c: c.cast("int"))
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda a, x: a + x) % 10


def kind_of(entity: Column) -> Column:
    """The first type, in the order of PATTERNS, whose pattern is all of the entity."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in PATTERNS.items():
        out = out.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out.otherwise(F.lit("phone"))


def _remainder(iban: Column) -> Column:
    """An IBAN (without spaces) modulo 97: letters count from 10, the first four characters come last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    values = F.transform(_characters(turned), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda sum_, v: (sum_ * F.when(v > 9, 100).otherwise(10) + v) % 97)


def canonical(kind: Column, entity: Column) -> Column:
    """What all mentions of one entity have in common."""
    digits = _digits(entity)
    named = _let(_units(entity), lambda units: F.concat(F.when(_led(units), "+").otherwise(""), F.array_join(F.transform(units, lambda u: _normal(_bare(u))), " ")))
    same = F.when(kind.isin("email", "ipv6"), F.lower(entity)).when(kind == "ipv4", entity).when(kind == "name", named)
    return same.when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "phone", F.concat(_country(entity), digits)).otherwise(digits)


def _units(entity: Column) -> Column:
    """The words and initials of a titled name, each with the particles before it."""
    untitled = F.regexp_replace(entity, rf"^{_TITLED}", "")
    return F.split(untitled, rf"(?<!(?:^| )(?:{_PARTICLE})) ")


def _bare(unit: Column) -> Column:
    """A word without the particles before it."""
    return F.regexp_replace(unit, rf"^{_LEAD}", "")


def _led(units: Column) -> Column:
    """Whether a name begins with particles: then it has no given name."""
    return F.get(units, F.lit(0)) != _bare(F.get(units, F.lit(0)))


def _normal(word: Column) -> Column:
    """Words in capitals with a capital only."""
    return F.when(word == F.upper(word), F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, F.lit(2), F.char_length(word))))).otherwise(word)


def _as(new: Column, like: Column) -> Column:
    """``new`` in capitals where ``like`` is, after the particles of ``like``."""
    return F.concat(F.regexp_extract(like, rf"^({_LEAD})", 1), F.when(_bare(like) == F.upper(_bare(like)), F.upper(new)).otherwise(new))


def _country(entity: Column) -> Column:
    """The + and country code of a telephone number: as set apart, else by the codes' numbering; empty without a +."""
    return F.regexp_extract(entity, rf"^(\+(?:[0-9]{{1,3}}(?=[ ./(-])|{_CODES}))", 1)


def _name_words(entity: Column, key: str) -> Column:
    """array<struct<unit, old, new>>: the words of a titled name, without particles and capitals, and their surrogates."""
    lists = [F.array(*map(F.lit, names.split())) for names in NAMES.values()]
    every = F.array(*(F.lit(n) for names in NAMES.values() for n in names.split()))

    def of_units(units: Column) -> Column:
        def of_words(words: Column) -> Column:
            rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
            # a word alone is a family name, and so is one after particles
            given = lambda i: (i == 0) & (F.size(words) > 1) & ~_led(units)

            def one(w: Column, i: Column) -> Column:
                return _let(F.when(given(i), F.concat(F.lit(f"{key}|given|"), rest)).otherwise(F.lit(f"{key}|family")), lambda own: changed(w, own))

            def changed(w: Column, own: Column) -> Column:
                shift = F.conv(F.substring(F.sha2(F.concat(F.lit("list|"), own).cast("binary"), 256), 1, 6), 16, 10).cast("int")
                # cycle walking: a spelled word that falls on a list is permuted again, so that it meets no listed one
                walk = lambda g, n: F.when((n == 0) | F.array_contains(every, g), _permuted(g, own, SOUNDS)).otherwise(g)
                new = F.when(F.lit(False), F.lit(""))
                for names in lists:
                    n, at = F.size(names), F.array_position(names, w) - 1
                    new = new.when(at >= 0, F.get(names, F.pmod(at.cast("int") + 1 + F.pmod(shift, n - 1), n).cast("int")))
                return new.otherwise(F.aggregate(F.array(*map(F.lit, range(5))), w, walk))

            return F.transform(words, lambda w, i: F.struct(F.get(units, i).alias("unit"), w.alias("old"), one(w, i).alias("new")))

        return _let(F.transform(units, lambda u: _normal(_bare(u))), of_words)

    return _let(_units(entity), of_units)


def surrogate(entity: Column, key: str) -> Column:
    """The replacement of one mention."""
    keyed = lambda name: F.lit(f"{key}|{name}")

    def email(e: Column) -> Column:
        top = F.regexp_extract(e, rf"({_TOP})$", 1)
        body = F.substring(e, F.lit(1), F.char_length(e) - F.char_length(top))
        return F.concat(_recased(_permuted(F.lower(body), F.concat_ws("|", keyed("email"), F.lower(top)), LETTERS), body), top)

    def ipv4(e: Column) -> Column:
        octets = F.transform(F.split(e, r"\."), lambda o: F.struct(o.cast("int").alias("v"), F.lit(256).alias("size")))
        return F.array_join(F.transform(_moved(octets, keyed("ipv4")), lambda s: s["v"].cast("string")), ".")

    def ipv6(e: Column) -> Column:
        return _recased(_permuted(F.lower(e), keyed("ipv6"), ["0123456789abcdef"]), e)

    def iban(e: Column) -> Column:
        def of(own: Column) -> Column:
            country, body = F.substring(own, 1, 2), F.substring(own, F.lit(5), F.char_length(own))
            new = _permuted(body, F.concat_ws("|", keyed("iban"), country), LETTERS[:1] + LETTERS[2:3])

            def checked(n: Column) -> Column:
                # the check digits restore the remainder
                check = F.pmod(_remainder(own) - _remainder(F.concat(country, F.lit("00"), n)), F.lit(97))
                return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), n)

            return _let(new, checked)

        return _refilled(e, _let(F.replace(e, F.lit(" "), F.lit("")), of), "[A-Z0-9]")

    def card(e: Column) -> Column:
        def from_digits(d: Column) -> Column:
            head, middle = F.substring(d, 1, 1), F.substring(d, F.lit(2), F.char_length(d) - 2)
            new = F.concat(head, _permuted(middle, F.concat_ws("|", keyed("card"), head, _luhn(d).cast("string")), LETTERS[:1]))
            # the last digit restores the Luhn sum
            return _let(new, lambda n: F.concat(n, F.pmod(_luhn(d) - _luhn(F.concat(n, F.lit("0"))), F.lit(10)).cast("string")))

        return _refilled(e, _let(_digits(e), from_digits))

    def ssn(e: Column) -> Column:
        return _permuted(e, keyed("ssn"), LETTERS[:1])

    def phone(e: Column) -> Column:
        code = _country(e)
        rest = F.substring(e, F.char_length(code) + 1, F.char_length(e))
        return F.concat(code, _refilled(rest, _permuted(_digits(rest), F.concat_ws("|", keyed("phone"), code), LETTERS[:1])))

    def name(e: Column) -> Column:
        return F.concat(F.regexp_extract(e, rf"^({_TITLED})", 1), _let(e, lambda own: F.array_join(F.transform(_name_words(own, key), lambda w: _as(w["new"], w["unit"])), " ")))

    def chosen(e: Column) -> Column:
        kind = kind_of(e)
        return F.when(kind == "email", email(e)).when(kind == "ipv4", ipv4(e)).when(kind == "ipv6", ipv6(e)).when(kind == "iban", iban(e)).when(kind == "card", card(e)).when(kind == "ssn", ssn(e)).when(kind == "name", name(e)).otherwise(phone(e))

    return _let(entity, chosen)


def _parts(text: Column, pattern: str = ENTITY) -> Column:
    """The text cut at its entities: these are the elements at odd indexes."""
    text = F.translate(text, _MARK, "\u0002")
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def _may_hold(text: Column) -> Column:
    """A quick necessary condition for an entity."""
    return text.rlike(rf"[0-9][0-9 ./()-]{{5}}|@|[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]{{9}}|:[0-9A-Fa-f]{{0,4}}:|{_TITLED}\p{{L}}")


def _mentions(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def _names(parts: Column, key: str) -> Column:
    """array<struct<old, next, new>>: words of the titled names of a text, each with the word that must follow it (null: any) and its surrogate."""

    def pairs(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(w["old"].alias("old"), F.get(words, i + 1)["old"].alias("next"), w["new"].alias("new")))

    titled = F.filter(_mentions(parts), lambda e: e.rlike(rf"^{PATTERNS['name']}$"))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(titled), lambda e: pairs(_name_words(e, key)))))


def _replaced(parts: Column, names: Column, key: str) -> Column:
    """The parts with surrogates for entities and for words of the names; without names all mentions are entities."""
    entity = lambda p: p.rlike(rf"^(?:{ENTITY})$")
    common = F.array(*map(F.lit, COMMON.split()))

    def one(p: Column, i: Column) -> Column:
        def of(word: Column) -> Column:
            follows = F.when(F.get(parts, i + 1) == " ", _normal(_bare(F.get(parts, i + 2))))
            begins = (word == p) & ((i == 1) & ~F.get(parts, i - 1).rlike("[\\p{L}\\p{N}]") | F.get(parts, i - 1).rlike(_BEFORE))
            alone = ~(begins & F.array_contains(common, word))
            known = F.filter(names, lambda n: (n["old"] == _normal(word)) & ((n["next"].isNull() & alone) | (n["next"] == follows)))
            # words that follow each other count before one alone
            best = F.coalesce(F.get(F.filter(known, lambda n: n["next"].isNotNull()), F.lit(0)), F.get(known, F.lit(0)))
            return F.when(F.size(known) > 0, _as(best["new"], p)).otherwise(p)

        return F.when(i % 2 == 0, p).when((F.size(names) == 0) | entity(p), surrogate(p, key)).otherwise(_let(_bare(p), of))

    return F.transform(parts, one)


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, type, entity, canonical): all mentions in ``docs`` (doc_id, text, ...)."""
    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(_may_hold(F.col("text")))
    found = found.select("doc_id", F.explode(_mentions(_parts(F.col("text")))).alias("entity")).withColumn("type", kind_of(F.col("entity")))
    return found.select("doc_id", "type", "entity", canonical(F.col("type"), F.col("entity")).alias("canonical"))


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """(type, canonical, surrogate): one row for each distinct entity, with its surrogate in the same reduced form."""
    distinct = entities(docs).groupBy("type", "canonical").agg(F.min("entity").alias("entity"))
    new = surrogate(F.col("entity"), key)
    return distinct.withColumn("new", new).select("type", "canonical", canonical(F.col("type"), F.col("new")).alias("surrogate"))


def collisions(found: DataFrame) -> DataFrame:
    """(type, surrogate, n): surrogates that several entities share."""
    return found.groupBy("type", "surrogate").agg(F.countDistinct("canonical").alias("n")).where("n > 1")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its entities replaced in text, and n_entities, the number of replaced mentions (a column of that name is replaced).

    ValueError if two entities of a type would get the same surrogate. A null
    text stays null, with 0 entities; an empty one stays empty. A text without
    entities comes back unchanged, but for U+0001, which becomes U+0002 in texts
    with entities. Characters of no listed script stay; a mention of nothing else
    is not counted. Rows are independent of each other and of doc_id.
    """
    clash = collisions(materialize(surrogates(docs, key), "surrogates")).limit(5).collect()
    if clash:
        raise ValueError(f"several entities share a surrogate under this key: {[tuple(r) for r in clash]}")
    text = F.col("text").cast("string")
    parts = F.when(_may_hold(text), _parts(text)).otherwise(F.array(text))
    done = docs.drop("n_entities").withColumn("_parts", parts).withColumn("_names", F.when(F.size("_parts") > 1, _names(F.col("_parts"), key)))
    # only a text with names is cut again, at its capitalized words too
    again = F.size("_names") > 0
    done = done.withColumn("_parts", F.when(again, _parts(text, WORDS)).otherwise(F.col("_parts")))
    done = done.withColumn("_new", F.when(F.size("_parts") > 1, _replaced(F.col("_parts"), F.col("_names"), key)))
    changed = F.size(F.filter(F.zip_with("_parts", "_new", lambda old, n: old != n), lambda x: x))
    n = F.coalesce(F.when(F.size("_parts") > 1, changed), F.lit(0)).cast("long")
    return done.withColumns({"text": F.when(F.size("_parts") > 1, F.array_join("_new", "")).otherwise(text), "n_entities": n}).drop("_parts", "_names", "_new")
