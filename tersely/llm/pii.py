"""Surrogate generation for personal data (operator 9), DataFrame expressions only.

Entities are found by one pattern with an alternative for each kind. Each gets a replacement that a key and the
entity alone decide, so a mention is replaced alike in every document (coreference). Kinds whose text is
digits (cards, phones, social security and IP numbers) go through a keyed Feistel network over their digits, a
bijection on numbers of one format: distinct numbers stay distinct, separators, the country code and a card's
first digit and checksum validity stay. Letters of e-mail addresses, secrets and account numbers are replaced
by letters of the same script and case from a keyed stream. Given and family names are replaced one by one, a
given name by one of its gender and script, so that a person's family name is the same with and without the
given one. A name is found by its title; in that text it, and its family name, are then replaced without the
title as well.

Collision check: all distinct addresses, secrets, accounts, given and family names of the corpus are listed. Where
several draw one replacement the smallest keeps it; the others draw again from a space that grows with the
attempt (another family name with a syllable more, a double given name, an address with a letter more), and what
they draw is checked against all that is taken, until no two share one. Only attempts are brought back to texts.

Edge cases: null text stays null with no entities; empty text, ties, repeated rows and empty tables pass
through; a text of megabytes is one row like any other, patterns have no unbounded backtracking; extra columns of
the input are kept whatever their names, but for one named like the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import cut

#: Where the secret key is set; without it a public key is taken, whose replacements anyone can make.
KEY_SETTING = "spark.tersely.surrogates.key"
PUBLIC_KEY = "surrogate-key-1"
HEX = "0123456789abcdef"

# Given names by gender, titles by gender.
FEMALE = ["Anna", "Clara", "Elena", "Emma", "Greta", "Hanna", "Ida", "Julia", "Laura", "Lena", "Maria", "Marta", "Nina", "Olga", "Paula", "Sofia"]
MALE = ["Adam", "Anton", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Jonas", "Leon", "Lukas", "Martin", "Oskar", "Paul", "Simon", "Viktor"]
SYLLABLES = ["ba", "ber", "dal", "den", "fel", "gar", "hol", "kan", "ler", "lin", "mar", "mon", "nor", "ral", "sen", "ver"]
CYRILLIC_FEMALE = ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"]
CYRILLIC_MALE = ["Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"]
CYRILLIC_SYLLABLES = ["ба", "вер", "дан", "кол", "лин", "мар", "нор", "сен"]
FEMALE_TITLES = "Mrs|Ms|Miss|Mme|Frau|Sra|Señora|Madame|Г-жа"
MALE_TITLES = "Mr|Herr|Sr|Señor|Monsieur|Г-н"

# A phone's groups: an address after a space is none, and a space after a hyphen or dot ends the number.
GROUP = "[0-9]{2,4}"
SPACED = f"(?: (?!(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}(?!\\.?[0-9])))?{GROUP}"
AREA = f"(?:\\([0-9]{{2,4}}\\)|{GROUP})"
NORTH_AMERICA = "\\+1[ .-]?(?:\\([0-9]{3}\\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
ABROAD = f"\\+[0-9]{{1,3}}[ .-]?{AREA}(?:[.-]{GROUP}|{SPACED})(?:(?:{SPACED}){{1,3}}(?:[.-]?{GROUP}){{0,2}}|(?:[.-]?{GROUP}){{1,3}})(?![0-9])"

# The kinds, in the order in which they are tried at a place in the text.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
KINDS = [
    ("email", "(?<![\\p{L}0-9._%+-])[\\p{L}0-9._%+-]++@(?:[\\p{L}0-9-]{1,63}\\.){1,126}[\\p{L}]{2,63}(?![\\p{L}0-9-])"),
    ("ip", f"(?<![0-9.])(?:{OCTET}\\.){{3}}{OCTET}(?![0-9]|\\.[0-9])"),
    ("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", f"(?<![\\p{{L}}0-9+])(?:{NORTH_AMERICA}|{ABROAD})"
              "|(?<![\\p{L}0-9(])\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\\p{L}0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("card", "(?<![\\p{L}0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![\\p{L}0-9])"),
    ("account", "(?<![\\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}0-9])"),
    ("secret", "(?<![\\p{L}0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,}+)(?![\\p{L}0-9])"),
    ("name", f"(?<![\\p{{L}}])(?:{FEMALE_TITLES}|{MALE_TITLES})\\.? \\p{{Lu}}\\p{{Ll}}{{1,24}}(?: \\p{{Lu}}\\p{{Ll}}{{1,24}})?(?![\\p{{L}}])"),
]
#: No entity begins inside a word; that test comes first, as it rules out most places in a text.
PATTERN = "(?<![\\p{L}0-9])(?:" + "|".join(f"(?:{p})" for _, p in KINDS) + ")"
# A text without a digit, an at sign or one of these has no entity.
HINTS = [*FEMALE_TITLES.split("|"), *MALE_TITLES.split("|"), "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]


def maybe(text: Column) -> Column:
    """The cheap test before the full pattern: single characters and plain substrings."""
    out = text.rlike("[0-9@]")
    for hint in HINTS:
        out = out | text.contains(hint)
    return out


def mentions(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(maybe(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


TITLE = f"^(?:{FEMALE_TITLES}|{MALE_TITLES})\\.? "


def titled(found: Column) -> Column:
    """The names among the mentions of a text; they all have a title."""
    return F.filter(found, lambda e: e.rlike(TITLE))


def untitled(entity: Column) -> Column:
    return entity.rlike("^\\p{Lu}\\p{Ll}{1,24}(?: \\p{Lu}\\p{Ll}{1,24})?$") & ~entity.rlike(TITLE)


def pattern_with(names: Column) -> Column:
    """The pattern, and the names' whole and family parts wherever they stand without a title."""
    whole = F.transform(names, lambda e: F.regexp_replace(e, TITLE, ""))
    bare = F.array_distinct(F.concat(whole, F.transform(whole, lambda n: F.substring_index(n, " ", -1))))
    first = F.array_sort(bare, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(PATTERN + "|(?<![\\p{L}0-9])(?:"), F.array_join(first, "|"), F.lit(")(?![\\p{L}0-9])"))


def as_titled(entity: Column, names: Column, to: Column) -> Column:
    """An untitled mention's replacement: that of the first name that it is or ends, as far as it is mentioned."""
    at = F.array_position(F.transform(names, lambda n: F.regexp_replace(n, TITLE, "") == entity), True)
    ends = F.array_position(F.transform(names, lambda n: F.endswith(n, F.concat(F.lit(" "), entity))), True)
    new = F.regexp_replace(F.element_at(to, F.when(at > 0, at).otherwise(ends).cast("int")), TITLE, "")
    return F.when(entity.contains(" "), new).otherwise(F.substring_index(new, " ", -1))


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for name, _ in reversed(KINDS[:-1]):
        test = {
            "email": entity.contains("@"),
            "ip": entity.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"),
            "ssn": entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
            "phone": entity.rlike("^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"),
            "card": entity.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"),
            "account": entity.rlike("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$") & ~entity.rlike("^[0-9A-F]{32,}$"),
            "secret": ~entity.contains(" "),
        }[name]
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def key_of(key: str | None) -> str:
    """The key given, or the session's."""
    if key is not None:
        return key
    spark = SparkSession.getActiveSession()
    return PUBLIC_KEY if spark is None else spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def keyed(key: str | Column, *parts: Column, digits: int = 15) -> Column:
    """A number of ``digits`` hexadecimal digits from the key and the parts; parts are never null here."""
    tag = F.sha2(F.concat_ws("\x1f", F.lit(key) if isinstance(key, str) else key, *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(tag, 1, digits), 16, 10).cast("long")


def feistel(digits: Column, key: str | Column, rounds: int = 4) -> Column:
    """A keyed bijection on strings of digits of one length (up to 18)."""
    def halves(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        return F.struct(F.substring(d, F.lit(1), left).alias("a"), F.substring(d, left + 1, F.length(d)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        size = F.length(s["a"])
        modulus = F.pow(F.lit(10.0), size).cast("long")
        value = F.when(size > 0, s["a"]).otherwise(F.lit("0")).cast("long")
        mixed = F.pmod(value + F.pmod(keyed(key, r, size, s["b"]), modulus), modulus)
        return F.struct(s["b"].alias("a"), F.when(size > 0, F.lpad(mixed.cast("string"), size, "0")).otherwise(F.lit("")).alias("b"))

    return let(digits, lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), halves(d), turn, lambda s: F.concat(s["a"], s["b"])))


def luhn_sum(digits: Column) -> Column:
    """The checksum's sum over digits that stand before the check digit, its nearest one doubled."""
    def one(d: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return let(digits, lambda d: F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda total, i: total + one(d, i)))


def refill(entity: Column, digits: Column, skip: Column) -> Column:
    """The entity with its digits after the first ``skip`` characters replaced in order by ``digits``."""
    def fill(rest: Column, new: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.when(
            F.substring(rest, i, F.lit(1)).rlike("[0-9]"),
            F.substring(new, F.length(F.regexp_replace(F.substring(rest, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substring(rest, i, F.lit(1)))), "")

    rest = F.substring(entity, skip + 1, F.length(entity))
    return F.concat(F.substring(entity, F.lit(1), skip), let(rest, lambda r: let(digits, lambda new: fill(r, new))))


def number_surrogate(entity: Column, kind: Column, key: str) -> Column:
    """All digits of a social security number, those of a phone number after the country code, and those of a
    card between its first and its check digit; a card that passes the checksum gets one that does, any other
    one that does not."""
    card = kind == "card"
    country = F.when(kind == "phone", F.length(F.regexp_extract(entity, "^\\+[0-9]{1,3}(?=[ .(-])", 0))).otherwise(0)

    def with_check(d: Column, body: Column) -> Column:
        n = F.length(d)
        off = (luhn_sum(F.substring(d, F.lit(1), n - 1)) + F.substring(d, n, F.lit(1)).cast("int")) % 10
        return F.concat(body, F.pmod(off - luhn_sum(body), F.lit(10)).cast("string"))

    def new(d: Column) -> Column:
        inner = F.when(card, F.substring(d, F.lit(2), F.length(d) - 2)).otherwise(d)
        return let(feistel(inner, F.concat(F.lit(f"{key}/"), kind)), lambda mixed: F.when(
            card, let(F.concat(F.substring(d, 1, 1), mixed), lambda body: with_check(d, body))).otherwise(mixed))

    def whole(skip: Column) -> Column:
        return refill(entity, let(F.regexp_replace(F.substring(entity, skip + 1, F.length(entity)), "[^0-9]", ""), new), skip)

    return let(country, whole)


def ip_surrogate(entity: Column, key: str) -> Column:
    """A keyed bijection on 32-bit addresses, by a Feistel network on their halves."""
    def start(o: Column) -> Column:
        return F.struct((F.element_at(o, 1) * 256 + F.element_at(o, 2)).alias("a"), (F.element_at(o, 3) * 256 + F.element_at(o, 4)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(keyed(key, F.lit("ip"), r, s["b"]), F.lit(65536)), F.lit(65536)).alias("b"))

    def written(s: Column) -> Column:
        return F.concat_ws(".", *[F.floor(h / 256).cast("string") if top else (h % 256).cast("string") for h in (s["a"], s["b"]) for top in (True, False)])

    octets = F.transform(F.split(entity, "\\."), lambda x: x.cast("long"))
    return let(octets, lambda o: F.aggregate(F.sequence(F.lit(1), F.lit(4)), start(o), turn, written))


def stream(text: Column, seed: Column, key: str, hexadecimal: Column) -> Column:
    """Each letter or digit replaced by one of its class: digit, case, script; other characters stay."""
    pools = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("[à-öø-ÿ]", "àáâäçèéêëíîïñóôöúûü"), ("[а-я]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-Я]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω")]

    def swap(c: Column, draw: Column) -> Column:
        out = c
        for pattern, pool in reversed(pools):
            out = F.when(c.rlike(pattern), F.substring(F.lit(pool), (F.pmod(draw, F.lit(len(pool))) + 1).cast("int"), F.lit(1))).otherwise(out)
        digit = F.substring(F.lit(HEX), (F.pmod(draw, F.lit(16)) + 1).cast("int"), F.lit(1))
        return F.when(hexadecimal, F.when(c.rlike("[A-F]"), F.upper(digit)).otherwise(digit)).otherwise(out)

    # the seed's digest, as a seed may be as long as the text
    return let(F.sha2(seed.cast("binary"), 256), lambda own: F.array_join(F.transform(F.split(text, ""), lambda c, i: let(
        keyed(key, own, i + 1, digits=8), lambda draw: swap(c, draw))), ""))


def letter_surrogate(entity: Column, kind: Column, key: str, attempt: Column) -> Column:
    """Parts that stay and parts that are replaced. Of an address, the local part depends on the whole of it, the
    host on the domain alone, and the top level stays; of a secret or an account, a known beginning stays. Later
    attempts draw otherwise, and an address gets a letter more each time."""
    def part(text: Column, seed: Column | None = None) -> Column:
        return F.struct(text.alias("text"), (F.lit("") if seed is None else seed).alias("seed"), F.lit(seed is None).alias("stays"))

    again = F.when(attempt > 0, F.concat(F.lit("/"), attempt.cast("string"))).otherwise(F.lit(""))
    domain = F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    local = F.concat(F.substring_index(entity, "@", 1), F.repeat(F.lit("x"), attempt))
    address = F.array(part(local, F.concat(F.lower(entity), again)), part(F.lit("@")),
                      part(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), F.lower(domain)), part(F.concat(F.lit("."), top)))
    begins = F.when(kind == "account", 2).otherwise(F.length(F.regexp_extract(entity, "^(?:AKIA|gh[pousr]_|sk-)", 0)))
    other = F.array(part(F.substring(entity, F.lit(1), begins)), part(F.substring(entity, begins + 1, F.length(entity)), F.concat(entity, again)))
    hexadecimal = (kind == "secret") & entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    parts = F.when(kind == "email", address).otherwise(other)
    return let(hexadecimal, lambda hexa: F.array_join(F.transform(parts, lambda p: F.when(
        p["stays"] | (p["text"] == ""), p["text"]).otherwise(stream(p["text"], p["seed"], key, hexa))), ""))


def drawn(pool: list[str], h: Column, at: Column) -> Column:
    """The ``at``-th draw from a pool of 8 or 16, three or four bits of ``h`` each."""
    bits = len(pool).bit_length() - 1
    word = F.call_function("shiftright", h, (at * bits).cast("int")).bitwiseAND(F.lit(len(pool) - 1))
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (word + 1).cast("int"))


def is_cyrillic(name: Column) -> Column:
    return name.rlike("^[А-яЁё]")


def family_surrogate(name: Column, key: str, attempt: Column) -> Column:
    """Four keyed syllables of the name's script, one more with each attempt."""
    def of(pool: list[str], h: Column) -> Column:
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt + 3, F.lit(14))), lambda j: drawn(pool, h, j)), ""))

    return let(keyed(key, F.lit("family"), name, attempt), lambda h: F.when(is_cyrillic(name), of(CYRILLIC_SYLLABLES, h)).otherwise(of(SYLLABLES, h)))


def given_surrogate(name: Column, female: Column, key: str, attempt: Column) -> Column:
    """A given name of the gender and script; a double one at the second attempt, and so on."""
    def of(pool: list[str], h: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(14))), lambda j: drawn(pool, h, j)), "-")

    return let(keyed(key, F.lit("given"), name, attempt), lambda h: F.when(
        is_cyrillic(name), F.when(female, of(CYRILLIC_FEMALE, h)).otherwise(of(CYRILLIC_MALE, h))).otherwise(
        F.when(female, of(FEMALE, h)).otherwise(of(MALE, h))))


# --- who is replaced: a kind and a value, alike for mentions that are one ------------------------------------

APART = "\x1f"
FAMILY, GIVEN_FEMALE, GIVEN_MALE = "family", "given-f", "given-m"


def who(kind: Column | str, value: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(APART), value)


def canonical(entity: Column) -> Column:
    """Mentions that differ in the letter case of an address only are one entity."""
    return F.when(entity.contains("@"), F.lower(entity)).otherwise(entity)


def name_parts(entity: Column) -> Column:
    """(title, given, family, female) of a titled name; ``given`` is null without one."""
    def of(title: Column) -> Column:
        rest = F.substring(entity, F.length(title) + 1, F.length(entity))
        return F.struct(title.alias("title"), F.when(rest.contains(" "), F.substring_index(rest, " ", 1)).alias("given"),
                        F.substring_index(rest, " ", -1).alias("family"), title.rlike(f"^(?:{FEMALE_TITLES})(?:\\.| )").alias("female"))

    return let(F.regexp_extract(entity, TITLE, 0), of)


def given_kind(female: Column) -> Column:
    return F.when(female, GIVEN_FEMALE).otherwise(GIVEN_MALE)


def who_in(found: Column) -> Column:
    """Whom the mentions of a text name, of the kinds whose replacements could meet."""
    def of_name(e: Column) -> Column:
        return let(name_parts(e), lambda n: F.array_compact(F.array(who(FAMILY, n["family"]), F.when(n["given"].isNotNull(), who(given_kind(n["female"]), n["given"])))))

    def of(e: Column, kind: Column) -> Column:
        return F.when(kind == "name", of_name(e)).when(kind.isin("email", "account", "secret"), F.array(who(kind, canonical(e)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(found, lambda e: let(kind_of(e), lambda kind: of(e, kind)))))


def drawn_for(one: Column, key: str, attempt: int) -> Column:
    """What ``one`` (a ``who``) draws at an attempt, in the form in which two replacements are the same."""
    kind, value, n = F.substring_index(one, APART, 1), F.substring_index(one, APART, -1), F.lit(attempt)
    to = (F.when(kind == FAMILY, family_surrogate(value, key, n)).when(kind == GIVEN_FEMALE, given_surrogate(value, F.lit(True), key, n))
          .when(kind == GIVEN_MALE, given_surrogate(value, F.lit(False), key, n)).otherwise(letter_surrogate(value, kind, key, n)))
    return who(kind, F.lower(to))


def surrogate(entity: Column, key: str | None = None, attempt_of: Callable[[Column], Column] = lambda one: F.lit(0)) -> Column:
    """The entity's replacement; ``attempt_of`` says how often a ``who`` must draw again. Values that several places
    need are bound once, as a lambda's variable."""
    key = key_of(key)

    def name(n: Column) -> Column:
        family = let(attempt_of(who(FAMILY, n["family"])), lambda a: family_surrogate(n["family"], key, a))
        given = let(attempt_of(who(given_kind(n["female"]), n["given"])), lambda a: given_surrogate(n["given"], n["female"], key, a))
        return F.concat(n["title"], F.when(n["given"].isNotNull(), F.concat(given, F.lit(" "))).otherwise(F.lit("")), family)

    def by_kind(e: Column, kind: Column) -> Column:
        letters = let(attempt_of(who(kind, canonical(e))), lambda a: letter_surrogate(e, kind, key, a))
        return (F.when(kind.isin("email", "account", "secret"), letters).when(kind.isin("ssn", "phone", "card"), number_surrogate(e, kind, key))
                .when(kind == "ip", ip_surrogate(e, key)).otherwise(let(name_parts(e), name)))

    return let(entity, lambda e: let(kind_of(e), lambda kind: by_kind(e, kind)))


def collisions(docs: DataFrame, key: str | None = None, text: str = "text", most_rounds: int = 100) -> DataFrame:
    """(who, attempt) of all that cannot keep their first draw, which another has as well.

    The texts are read once; the list holds each ``who`` once. A round lets those that are still open draw, and
    the smallest of each replacement has it unless it is taken; it ends when none is open.
    """
    key = key_of(key)
    open_ = cut(docs.select(F.explode(who_in(mentions(F.col(text)))).alias("who")).distinct())
    taken = moved = None
    for attempt in range(most_rounds):
        draws = open_.select("who", drawn_for(F.col("who"), key, attempt).alias("to"))
        won = draws.groupBy("to").agg(F.min("who").alias("who"))
        if taken is not None:
            won = won.join(taken, "to", "left_anti")
        won = cut(won)
        taken = won.select("to") if taken is None else taken.union(won.select("to"))
        have = won.select("who", F.lit(attempt).alias("attempt"))
        moved = have.limit(0) if moved is None else moved.union(have)
        open_ = cut(open_.join(won.select("who"), "who", "left_anti"))
        if open_.isEmpty():
            return moved
    raise RuntimeError("replacements did not become distinct")


def replace_documents(docs: DataFrame, key: str | None = None, text: str = "text", check: bool = True, out: str | None = "pii") -> DataFrame:
    """``docs`` with ``text`` replaced and ``out``, unless it is None: the kind, place in the original and length of each
    mention.

    Without collisions this is one pass over the rows with no shuffle. With some, the attempts of those who draw
    again are joined by who it is and brought back to their texts; the list is never on the driver.
    """
    key = key_of(key)
    moved = cut(collisions(docs, key, text)) if check else None
    rows = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs[text].alias("body"))
    rows = rows.withColumn("found", mentions(F.col("body")))
    if moved is not None and not moved.isEmpty():
        rows = rows.withColumn("id", F.when(F.size("found") > 0, F.xxhash64("body")))
        wanted = rows.where("id is not null").select("id", F.explode(who_in(F.col("found"))).alias("who")).distinct()
        attempts = (wanted.join(moved, "who").groupBy(F.col("id").alias("of"))
                    .agg(F.map_from_entries(F.collect_list(F.struct("who", "attempt"))).alias("attempts")))
        rows = rows.join(attempts, F.col("id") == F.col("of"), "left")

        def attempt_of(one: Column) -> Column:
            return F.coalesce(F.try_element_at(F.col("attempts"), one), F.lit(0))
    else:
        def attempt_of(one: Column) -> Column:
            return F.lit(0)

    def new(e: Column) -> Column:
        return surrogate(e, key, attempt_of)

    # only a text with a name is searched again, for mentions of it without the title
    rows = rows.withColumn("names", titled(F.col("found"))).withColumn("again", F.when(F.size("names") > 0, pattern_with(F.col("names"))))
    rows = rows.withColumn("found", F.when(F.col("again").isNotNull(), F.regexp_extract_all(F.col("body"), F.col("again"), F.lit(0))).otherwise(F.col("found")))
    rows = rows.withColumn("renamed", F.transform("names", new))
    to = F.transform("found", lambda e: F.when((F.size("names") > 0) & untitled(e), as_titled(e, F.col("names"), F.col("renamed"))).otherwise(new(e)))
    rows = rows.withColumn("gaps", F.when(F.col("again").isNotNull(), F.split(F.col("body"), F.col("again"), -1))
                           .when(F.size("found") > 0, F.split(F.col("body"), PATTERN, -1)))
    filled = F.array_join(F.zip_with("gaps", F.concat(to, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    placed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    ahead = F.transform("found", lambda e, i: F.struct(F.length(F.element_at("gaps", i + 1)).alias("gap"), F.length(e).alias("own")))
    starts = F.aggregate(ahead, placed, lambda s, x: F.struct((s["at"] + x["gap"] + x["own"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")), lambda s: s["starts"])
    spans = F.when(F.size("found") > 0, let(starts, lambda at: F.transform("found", lambda e, i: F.struct(
        F.when((F.size("names") > 0) & untitled(e), "name").otherwise(kind_of(e)).alias("kind"), F.element_at(at, i + 1).alias("start"), F.length(e).cast("long").alias("length")))))
    rows = rows.withColumn("filled", F.when(F.size("found") > 0, filled).otherwise(F.col("body")))
    rows = rows.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<kind:string,start:bigint,length:bigint>>")))
    kept = [F.col("filled").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out]
    return rows.select("row", "filled", "spans").select(*kept, *([F.col("spans").alias(out)] if out else []))
