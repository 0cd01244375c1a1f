"""Personal data and secrets: keyed surrogates of the same type and format, with DataFrame functions only.

Found: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card numbers (15 or 16 digits), IBANs, social-security numbers, hex
secrets (32 to 64 digits), access keys with a known prefix, names after a title, and the surname of such a name wherever it stands alone in the
same text.  A surrogate keeps what is not a letter or digit, each letter's case and script, a name's title, a country code, a top-level
domain, the prefix of a key, and whether a card number or an IBAN passes its check digits.

A name's word of the typed lists (given names of women and of men, surnames, in two scripts) becomes another word of its list with as many letters and the
same last letter: the next one in an order that the key decides. Any other word is spelled anew, with vowels for vowels, all but its last
letter, which tells gender in many languages, until it is no word of the lists. Both are one-to-one, and so is their union.

A surrogate is a keyed permutation of all strings of one format, so distinct entities get distinct surrogates and one entity
the same everywhere (coreference) without any table of entities: P is a Feistel network over the characters' places in their
alphabets, S adds an amount that is nowhere zero, and the surrogate is P^-1 S P, which leaves no string as it is.  What is permuted is the
entity without its spelling, which is put back after: a name word by word, whatever its title; the digits of telephone, card and
social-security numbers, whatever stands between; an e-mail address in lower case.  With check (the default) a pass over the distinct entities
of the corpus proves distinctness and stops if it fails.

Each text is matched once: entities are marked in it by a control character (those that it has are escaped), the marked texts are kept
in the checkpoint folder, and all else works on their parts.  Patterns that need an @ or a digit are left out for texts without one.  Nothing else
of a text changes.  Quantifiers are bounded or possessive: time is linear in the text.

Limits: a telephone number with and without its country code is two entities, and so is an IPv6 address written short and in full; names without a title
anywhere in the text are not found; what merely looks like an IBAN (two capitals, two digits, groups with eight digits or more) is taken for one.  The plan holds digests of the key by kind, not the key; whoever has them can invert surrogates, so event logs are
as secret as the key.

Defined results: null text stays null and has no entities; an entity without a letter or digit that may change stays (none of
the patterns matches one); order and repetition of rows do not matter; an empty table has no rows; other columns pass unchanged, but one named
kinds, which is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Titles before names.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Señorita", "Monsieur", "Madame", "Mademoiselle", "Signor", "Signora", "Господин", "Госпожа")
#: Words that begin a sentence or go on with it, which the third word of a name is not. Frequent surnames are left out.
ORDINARY = tuple(
    """
A After Also Although And As At Because Before Both But By Did Do Does During For From Had Has He Her Here His How However I If In It Its
Just Nevertheless Not Now Of On Once One Or Our She Since Some Soon Still Such That The Their Then There These They This Those Though Through
Thus To Today Tomorrow Until We Were What When Where Which While Who Why With Yesterday Yet You Your
Aber Als Am Auch Bei Bis Da Dann Das Dass Denn Der Die Doch Ein Eine Er Es Heute Ihr Im Ist Jetzt Mit Nach Nun Sie Und Wann Warum Was Weil Wenn Wer Wie Wir Wo
Ahora Aunque Cuando Después Él Ella Ellos Entonces Eso Esta Este Hoy Los Las Luego Mientras Pero Por Porque Qué Si Sin También
Alors Après Aussi Avec Avant Car Ce Ces Cette Dans Donc Elle Elles En Est Et Ils Je Les Mais Nous Où Puis Quand Que Qui Sans Une Vous
Allora Anche Che Dopo Ecco Gli Non Oggi Poi Perché Più Quando Quindi Se Sono
А Без Был Была Вот Вы Где Для Если И Как Когда Мы Но Он Она Они Потом Потому После Сегодня Тогда Что Это
""".split()
)
_LOCAL = r"[\p{L}\p{N}._%+\-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = "[0-9a-fA-F]{1,4}"
#: Access keys by their public prefixes.
PREFIXES = r"AKIA|ASIA|gh[oprsu]_|sk_(?:live|test)_|AIza|xox[abprs]-"
KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|sk_(?:live|test)_[0-9A-Za-z]{16,64}|AIza[0-9A-Za-z_\-]{35}|xox[abprs]-[0-9A-Za-z\-]{10,64}"
_NAME = r"\p{Lu}\p{Ll}{1,30}+"
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+@[\p{{L}}\p{{N}}\-]{{1,63}}(?:\.[\p{{L}}\p{{N}}\-]{{1,63}}){{1,8}}",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9a-fA-F:]{{0,38}}\d)(?=[0-9a-fA-F:]{{0,36}}[0-9a-fA-F]{{3}})(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\p{{L}}\p{{N}}:])(?!\.\d)",
    "key": rf"(?<![\p{{L}}\p{{N}}])(?:{KEYS})(?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![\p{L}\p{N}])(?=(?:[A-Z ]{0,12}\d){8})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}\-])|(?<![\p{L}\p{N}\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\p{L}\p{N}\-])|(?<![\p{L}\p{N}\-]|\d )\d{3} \d{3} \d{4}(?![\p{L}\p{N}\-]| \d)",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}])(?!\.\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{15,16}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "secret": r"(?<![\p{L}\p{N}])(?=[a-fA-F]{0,63}\d)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME}(?: (?!(?:{'|'.join(sorted(set(ORDINARY)))})(?!\p{{L}})){_NAME})?)?(?!\p{{L}})",
}
#: Country codes of telephone numbers with one and two digits; all others have three.
CODE = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}))"
_FIRST = "".join(sorted({t[0] for t in TITLES}))
_NUMBERS = "(?=[0-9a-fA-F:])" + PATTERNS["ipv6"] + "|(?=[Agsx])" + PATTERNS["key"] + "|(?=[A-Z])" + PATTERNS["iban"] + "|(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in ("phone", "ip", "card", "ssn")) + ")|(?=[0-9a-fA-F])" + PATTERNS["secret"]
_NAMES = f"(?=[{_FIRST}])" + PATTERNS["name"]
#: The patterns in order, each tried only where its first character may stand.
ANY = f"{PATTERNS['email']}|{_NUMBERS}|{_NAMES}"
KINDS = tuple(PATTERNS)
#: Mark around entities; what stands for it, and for the escape itself, in a text that has them.
MARK, ESCAPE, MARK_ESCAPED, ESCAPE_ESCAPED = "\u0001", "\u0002", "\u0002\u0003", "\u0002\u0004"
#: Letters of a surname that is also looked for alone, at least.
SURNAME = 3

#: Alphabets; a character of one of them is replaced by another of it.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäèéêëìíîïòóôöùúûü", "çñ", "ß", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "ÇÑ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")
ROUNDS = 4

#: Frequent given names of women and of men, and surnames, by script.
WOMEN = """
Ada Adele Agnes Alba Alice Alicia Amanda Amelia Anita Anna Anne Astrid Barbara Beate Beatrice Bella Birgit Carla Carmen Carol Caroline Catherine Celia Chiara
Christine Clara Claire Claudia Cristina Dana Daniela Daria Diana Dora Edith Elena Elisa Elisabeth Ella Ellen Elsa Emilia Emily Emma Erica Erika Esther Eva Fiona
Flora Florence Francesca Frida Gisela Giulia Gloria Grace Greta Hanna Hannah Heidi Helen Helena Helga Ida Ilse Ines Ingrid Irene Iris Isabel Jana Jane Janet Joan
Johanna Judith Julia Julie Karen Karin Kate Katharina Katrin Laura Lea Lena Leonie Lidia Lilly Linda Lisa Louise Lucia Lucy Luisa Lydia Maria Marie Marion Marta
Martha Martina Mary Megan Melanie Mia Michelle Miriam Monica Monika Nadia Nancy Natalie Nicole Nina Nora Olivia Paola Patricia Paula Petra Rachel Renate Rita Rosa
Rosalie Rose Ruth Sabine Sandra Sara Sarah Silvia Sofia Sonia Sophie Susan Susanne Sylvie Tanja Teresa Tina Ursula Valerie Vera Victoria Viola Yvonne
"""
MEN = """
Adam Adrian Alan Albert Alberto Alfred Andreas Andrew Anthony Antoine Anton Antonio Arthur Benjamin Bernard Bernd Bruno Carl Carlos Charles Christian Christoph Daniel
David Dennis Diego Dieter Dirk Dominik Donald Edgar Edward Emil Emilio Enrico Enrique Eric Erik Ernst Eugen Evan Felix Fernando Francesco Francisco Frank Franz Fred
Fritz Gary Georg George Gerald Gerhard Giovanni Giuseppe Glen Gordon Gustav Günter Hans Harald Harold Harry Heinrich Heinz Helmut Henri Henry Herbert Hermann Holger
Hugo Ivan Jack Jakob James Javier Jean Jens Joachim Johann John Jonas Jorge Josef Joseph José Juan Jürgen Karl Keith Kenneth Kevin Klaus Konrad Kurt Lars Leon Leonard
Lorenzo Luca Lucas Ludwig Luigi Luis Lukas Manuel Marc Marcel Marco Marcus Mario Mark Markus Mateo Matteo Matthew Matthias Michael Michel Miguel Nathan Neil Nicolas
Niklas Norbert Oliver Olivier Otto Owen Pablo Paolo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Ralf Ralph Raymond Ricardo Richard Robert Roberto Roger
Roland Rolf Rudolf Ryan Samuel Sean Sergio Simon Stefan Stefano Stephen Steven Sven Theodor Thomas Timothy Tobias Ulrich Victor Vincent Walter Werner Wilhelm William
Wolfgang Xavier
"""
SURNAMES = """
Adams Allen Baker Barnes Bauer Becker Bennett Berger Bianchi Booth Brandt Braun Brooks Brown Butler Campbell Carter Castillo Castro Clark Clarke Collins Colombo Conti
Cooper Davies Davis Delgado Dubois Dupont Durand Edwards Esposito Evans Fernández Ferrari Fischer Fisher Flores Foster Fournier Fuchs Gallo García Garnier Gauthier
Gibson Girard González Graham Greco Green Griffin Gutiérrez Gómez Günther Hall Hamilton Harris Hartmann Heath Henderson Hernández Hill Hoffmann Howard Huber Hughes
Jackson Jenkins Jiménez Johnson Jones Jäger Kaiser Keller Kelly Kennedy Klein Koch Krause Krämer Kruse Köhler König Lambert Lange Laurent Lehmann Leroy Lewis Lombardi
Lorenz López Maier Mancini Marino Marsh Martínez Mayer Meyer Miller Mitchell Moore Morales Moreau Morel Moreno Moretti Morgan Morris Murphy Murray Müller Navarro
Nelson Neumann Ortega Ortiz Parker Perrin Petit Phillips Porter Powell Price Pérez Ramos Ramírez Reyes Ricci Richards Richter Rivera Rizzo Roberts Robinson Rodríguez
Rogers Romano Romero Rossi Rousseau Ruiz Russell Russo Schmid Schmidt Schmitt Schneider Scholz Schröder Schubert Schulz Schulze Schwarz Schäfer Scott Simmons Smith
Stewart Sullivan Sánchez Taylor Thompson Torres Turner Vargas Vogel Wagner Walker Wallace Walsh Watson Weber Welsh White Wilson Winkler Winter Wright Ziegler
"""
WOMEN_CYRILLIC = "Алла Анна Вера Галина Дарья Елена Ирина Лариса Марина Мария Нина Ольга Полина Раиса Тамара Татьяна"
MEN_CYRILLIC = "Алексей Андрей Антон Борис Виктор Денис Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Роман Семён Сергей Степан"
SURNAMES_CYRILLIC = "Беляев Васильев Волков Жданов Зайцев Иванов Козлов Кузнецов Лебедев Морозов Новиков Орлов Павлов Петров Попов Сидоров Смирнов Соколов"
#: Times that a word outside the lists is spelled anew at most, until it is outside them again.
WALK = 16


def successors(key: str) -> dict[str, str]:
    """Each word of the typed lists with the one that takes its place: of the same list, length and last letter. A word that several lists have is of the first."""
    men = SURNAMES_CYRILLIC.split()
    classes: dict[tuple, list[str]] = {}
    seen: set[str] = set()
    for k, words in enumerate((WOMEN.split(), MEN.split(), SURNAMES.split(), WOMEN_CYRILLIC.split(), MEN_CYRILLIC.split(), men, [w + "а" for w in men])):
        for w in words:
            if w not in seen:
                seen.add(w)
                classes.setdefault((k, len(w), w[-1]), []).append(w)
    out = {}
    for words in classes.values():
        if len(words) > 1:  # a word without another of its kind is spelled anew
            words = sorted(words, key=lambda w: hashlib.sha256(f"{key}|word|{w}".encode()).digest())
            out |= dict(zip(words, words[1:] + words[:1], strict=True))
    return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind(entity: Column) -> Column:
    """The kind of a string that one of the patterns has matched."""
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(F.contains(entity, F.lit(":")), "ipv6")
        .when(entity.rlike(f"^(?:{PREFIXES})"), "key")
        .when(entity.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(entity.rlike(r"^(?:\d{15,16}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})$"), "card")
        .when(entity.rlike(r"^[0-9a-fA-F]{32,64}$"), "secret")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^[\d+(]"), "phone")
        .otherwise("name")
    )


def permuted(values: Column, radices: Column, tweak: Column) -> Column:
    """A keyed permutation of the arrays below radices, without fixed points if some radix is 2 or more."""
    forward = [(k, 1) for k in range(ROUNDS)]
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(sign).alias("sign")) for k, sign in [*forward, (-1, 0), *((k, -1) for k, _ in reversed(forward))]))

    def amount(seed: Column, at: Column) -> Column:
        return F.xxhash64(seed, at)

    def step(acc: Column, s: Column) -> Column:
        other = F.array_join(F.transform(F.filter(acc, lambda x, i: F.pmod(i + s["k"], F.lit(2)) == 1), lambda x: x.cast("string")), ",")
        seed = F.sha2(F.concat_ws("|", tweak, s["k"].cast("string"), F.when(s["k"] >= 0, other).otherwise(F.array_join(F.transform(radices, lambda r: r.cast("string")), ","))).cast("binary"), 256)

        def moved(h: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                r = F.element_at(radices, i + 1)
                feistel = F.when(F.pmod(i + s["k"], F.lit(2)) == 0, F.pmod(x + s["sign"] * F.pmod(amount(h, i), r), r)).otherwise(x)
                shift = F.when(r > 1, F.pmod(x + 1 + F.pmod(amount(h, i), F.greatest(r - 1, F.lit(1))), r)).otherwise(x)
                return F.when(s["k"] >= 0, feistel).otherwise(shift).cast("long")

            return F.transform(acc, one)

        return let(seed, moved)

    return F.aggregate(steps, values, step)


def _spelled(text: Column, tweak: Column, alphabets: tuple[str, ...], free: Column | None = None) -> Column:
    """text with its characters permuted inside their alphabets; free: for each character, may it change."""

    def with_chars(chars: Column) -> Column:
        def place(c: Column, i: Column) -> Column:
            for k, a in enumerate(alphabets, 1):
                has = F.instr(F.lit(a), c) > 0
                out = F.when(has, k) if k == 1 else out.when(has, k)
            out = out.otherwise(0)
            return out if free is None else F.when(F.element_at(free, i + 1), out).otherwise(0)

        tables = F.array(*(F.lit(a) for a in alphabets))

        def with_places(places: Column) -> Column:
            size = F.transform(places, lambda p: F.when(p > 0, F.length(F.element_at(tables, F.greatest(p, F.lit(1))))).otherwise(1).cast("long"))
            index = F.zip_with(chars, places, lambda c, p: F.when(p > 0, F.instr(F.element_at(tables, F.greatest(p, F.lit(1))), c) - 1).otherwise(0).cast("long"))
            shape = F.array_join(F.zip_with(chars, places, lambda c, p: F.when(p > 0, F.lit("\u0001")).otherwise(c)), "")
            new = let(size, lambda r: permuted(index, r, F.concat_ws("|", tweak, shape)))
            return let(new, lambda v: F.array_join(F.transform(chars, lambda c, i: F.when(F.element_at(places, i + 1) > 0, F.substring(F.element_at(tables, F.greatest(F.element_at(places, i + 1), F.lit(1))), (F.element_at(v, i + 1) + 1).cast("int"), F.lit(1))).otherwise(c)), ""))

        return let(F.transform(chars, place), with_places)

    return let(F.filter(F.split(text, ""), lambda c: c != ""), with_chars)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits that lacks its check digit."""
    n = F.length(digits)
    place = F.transform(F.sequence(F.lit(1), n), lambda k: let(F.substring(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(place, F.lit(0), lambda a, x: a + x)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _put_back(text: Column, new: Column, kind_: str = "0-9") -> Column:
    """text with its characters of a kind, digits, replaced in order by others."""
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), f"[^{kind_}]", ""))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(f"[{kind_}]"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")


def _cased(entity: Column, new: Column) -> Column:
    """new, which is in lower case, with upper case where entity has it."""
    return F.array_join(F.transform(F.filter(F.split(entity, ""), lambda c: c != ""), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")


def _number(entity: Column, tweak: Column) -> Column:
    return let(_spelled(_digits(entity), tweak, ALPHABETS[:1]), lambda new: _put_back(entity, new))


def _card(entity: Column, tweak: Column) -> Column:
    all_ = _digits(entity)
    body, last = F.substring(all_, F.lit(1), F.length(all_) - 1), F.substring(all_, F.length(all_), F.lit(1)).cast("int")
    check = lambda new: F.pmod(last + _luhn(body) - _luhn(new), F.lit(10)).cast("string")
    return let(let(_spelled(body, tweak, ALPHABETS[:1]), lambda new: F.concat(new, check(new))), lambda new: _put_back(entity, new))


def _ip(entity: Column, tweak: Column) -> Column:
    octets = F.transform(F.split(entity, r"\."), lambda x: x.cast("long"))
    return F.array_join(F.transform(permuted(octets, F.array(*[F.lit(256).cast("long")] * 4), tweak), lambda x: x.cast("string")), ".")


def _email(entity: Column, tweak: Column) -> Column:
    """The address in lower case is permuted; upper case is put back letter by letter."""
    low = F.lower(entity)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    name, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    new = F.concat(_spelled(local, F.concat_ws("|", tweak, F.lit("local"), domain), ALPHABETS), F.lit("@"), _spelled(name, F.concat_ws("|", tweak, F.lit("domain")), ALPHABETS), top)
    return F.when(entity == low, new).otherwise(let(new, lambda v: _cased(entity, v)))


def _ipv6(entity: Column, tweak: Column) -> Column:
    """Digits for digits and letters for letters, so that groups stay as short as they are."""
    new = _spelled(F.lower(entity), tweak, ("0123456789", "abcdef"))
    return F.when(entity == F.lower(entity), new).otherwise(let(new, lambda v: _cased(entity, v)))


def _key(entity: Column, tweak: Column) -> Column:
    prefix = F.regexp_extract(entity, f"^({PREFIXES})", 1)
    rest = F.substring(entity, F.length(prefix) + 1, F.length(entity))
    return F.concat(prefix, _spelled(rest, F.concat_ws("|", tweak, prefix), (ALPHABETS[0], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))


def _rest97(country: Column, body: Column) -> Column:
    """What is left of an IBAN with check digits 00, divided by 97."""
    chars = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) + 9)
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(entity: Column, tweak: Column) -> Column:
    """The account anew; check digits move by as much as the right ones do, so that right ones stay right and wrong ones wrong."""
    plain = F.replace(entity, F.lit(" "), F.lit(""))
    country, check, body = F.substring(plain, 1, 2), F.substring(plain, 3, 2).try_cast("int"), F.substring(plain, F.lit(5), F.length(plain))
    moved = lambda new: F.lpad(F.pmod(check + _rest97(country, body) - _rest97(country, new), F.lit(100)).cast("string"), 2, "0")
    whole = let(_spelled(body, F.concat_ws("|", tweak, country), ALPHABETS), lambda new: F.concat(country, moved(new), new))
    return let(whole, lambda new: _put_back(entity, new, "0-9A-Z"))


def _phone(entity: Column, tweak: Column) -> Column:
    code = F.regexp_extract(entity, CODE, 1)
    return F.concat(code, _number(F.substring(entity, F.length(code) + 1, F.length(entity)), F.concat_ws("|", tweak, code)))


def _name(entity: Column, tweak: Column, typed: dict[str, str]) -> Column:
    """Title as it is; each word by itself: the next of its typed list, or else all but its last letter spelled anew."""
    title = F.regexp_extract(entity, r"^(\S+ )", 1)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    free = lambda w: F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c, i: i + 1 < F.length(w))
    listed = F.create_map(*(F.lit(x) for pair in typed.items() for x in pair))
    # a permutation of all words, walked on until it leaves the lists, is one of the words outside them
    anew = lambda w: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), w, lambda acc, k: F.when((k == 1) | F.map_contains_key(listed, acc), _spelled(acc, tweak, ALPHABETS, free(acc))).otherwise(acc))
    return F.concat(title, F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(listed, w), anew(w))), " "))


def surrogate(entity: Column, key: str) -> Column:
    """The surrogate of a string that one of the patterns has matched."""
    tweak = lambda k: F.lit(hashlib.sha256(f"{key}|{k}".encode()).hexdigest())

    def of_kind(k: Column) -> Column:
        return (
            F.when(k == "email", _email(entity, tweak("email")))
            .when(k == "ip", _ip(entity, tweak("ip")))
            .when(k == "ipv6", _ipv6(entity, tweak("ipv6")))
            .when(k == "key", _key(entity, tweak("key")))
            .when(k == "iban", _iban(entity, tweak("iban")))
            .when(k == "card", _card(entity, tweak("card")))
            .when((k == "secret") & entity.rlike("[A-F]"), _spelled(entity, tweak("secret"), HEX[1:]))
            .when(k == "secret", _spelled(entity, tweak("secret"), HEX[:1]))
            .when(k == "phone", _phone(entity, tweak("phone")))
            .when(k == "ssn", _number(entity, tweak("ssn")))
            .otherwise(_name(entity, tweak("name"), successors(key)))
        )

    return let(kind(entity), of_kind)


def marked(text: Column) -> Column:
    """The text with a mark on both sides of each entity; its own control characters of that kind are escaped."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE_ESCAPED)), F.lit(MARK), F.lit(MARK_ESCAPED))
    plain = F.when(text.rlike(f"[{MARK}{ESCAPE}]"), escaped).otherwise(text)
    around = lambda pattern: F.regexp_replace(plain, f"({pattern})", f"{MARK}$1{MARK}")
    return F.when(F.contains(text, F.lit("@")), around(ANY)).when(text.rlike(f"[0-9]|{PREFIXES}"), around(f"{_NUMBERS}|{_NAMES}")).otherwise(around(_NAMES))


def parts(text: Column) -> Column:
    """A marked text's parts: plain ones and entities in turn, a plain one first and last."""
    return F.split(text, MARK, -1)


def entities_of(parts_: Column) -> Column:
    return F.filter(parts_, lambda x, i: F.pmod(i, F.lit(2)) == 1)


def with_surnames(text: Column) -> Column:
    """A marked text in which also the surnames of its names are marked, where they stand alone."""
    names = F.filter(entities_of(parts(text)), lambda e: (kind(e) == "name") & e.contains(" "))
    surnames = F.array_distinct(F.filter(F.transform(names, lambda e: F.element_at(F.split(e, " "), -1)), lambda w: F.length(w) >= SURNAME))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join(surnames, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    alone = lambda x, i: F.when(F.pmod(i, F.lit(2)) == 0, F.regexp_replace(x, pattern, F.lit(f"{MARK}$1{MARK}"))).otherwise(x)
    return F.when(F.contains(text, F.lit(MARK)) & (F.size(surnames) > 0), F.array_join(F.transform(parts(text), alone), MARK)).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(ESCAPE)), F.replace(F.replace(text, F.lit(MARK_ESCAPED), F.lit(MARK)), F.lit(ESCAPE_ESCAPED), F.lit(ESCAPE))).otherwise(text)


def detected(docs: DataFrame) -> DataFrame:
    """docs with its marked text in __marked, matched once and kept; a text without entities is not kept twice."""
    text = F.col("text").cast("string")
    found = docs.withColumn("__marked", marked(text)).withColumn("__marked", with_surnames(F.col("__marked")))
    return cut(found.withColumn("__marked", F.when(F.contains("__marked", F.lit(MARK)), F.col("__marked"))))


def collisions(found: DataFrame, key: str) -> DataFrame:
    """surrogate, entities: where several distinct entities of detected() texts got one surrogate (never, by construction)."""
    each = found.where("__marked is not null").select(F.explode(entities_of(parts(F.col("__marked")))).alias("entity")).distinct()
    return each.withColumn("surrogate", surrogate(F.col("entity"), key)).groupBy("surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def pseudonymised(docs: DataFrame, key: str, check: bool = True) -> DataFrame:
    """docs with surrogates in text, and the array kinds: the kind of each entity in order (a column of that name is replaced)."""
    found = detected(docs)
    if check and (bad := collisions(found, key).head(1)):
        raise ValueError(f"surrogates collide: {bad[0].entities} entities")
    pieces = F.transform(parts(F.col("__marked")), lambda x, i: F.when(F.pmod(i, F.lit(2)) == 1, surrogate(x, key)).otherwise(x))
    text = F.col("text").cast("string")
    new = F.when(F.col("__marked").isNotNull(), let(F.array_join(pieces, ""), unescaped)).otherwise(text)
    kinds = F.coalesce(F.transform(entities_of(parts(F.col("__marked"))), kind), F.array().cast("array<string>"))
    return found.withColumn("text", new).withColumn("kinds", kinds).drop("__marked")
