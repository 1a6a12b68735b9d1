"""Surrogates for personal data and secrets (operator 8), in DataFrame functions only.

One pattern finds e-mail addresses, keys and passwords, telephone numbers, IPv4 and IPv6 addresses, card and similar
numbers, US social security numbers, IBANs, and names (after an honorific or words like "my name is" or "dear", before
an address in brackets, or a known given name before a surname). Each is brought to one canonical form, which is
replaced by a keyed hash of its type; the replacement is then written the way the entity was. So the same entity reads
the same in every document, whatever its spelling:

* digits stay digits and letters letters; separators, country codes, issuer digits and prefixes stay;
* a telephone number is its digits with the country code of the dialling plan (ten digits without one are of code 1;
  a "(0)" after a code is no digit of it; a number with a trunk 0 and no code stays apart, as its country is unknown);
* a card number that passes the Luhn check is replaced by one that passes it, and so is an IBAN with its check digits;
  both without their separators, an address without its case (all capitals stay so);
* a name keeps its honorific, script and case, and a known given name its gender; each word of a name is an entity of
  its own, so "Mr. Smith" and "JOHN SMITH" share their surname, however often it was drawn again;
* an e-mail's domain is an entity of its own, so addresses of one domain still share it; its replacement lies under
  ``example.com``, ``.net``, ``.org`` or ``.example``, which nobody can own;
* a secret runs to its closing quote in the line, else to the next blank or quote (less punctuation at its end),
  whatever its length; separators stay, letters of other alphabets become Latin ones, and other symbols change.

Collision check: over all distinct entities, a replacement that two entities share, or that is itself an entity of
the corpus, is drawn again with the next attempt number until none is left. Words, e-mails and secrets grow by some
letters with further attempts, so that crowded short ones come apart too; formats of fixed length are drawn anew,
and after ``rounds`` without success the job fails rather than let two entities share a surrogate. Few entities need
it; their attempts reach the documents by a join.

The key is the argument, else ``spark.metricmart.pii.key``; without either, one drawn for the session, so that nobody
who has the code can look surrogates up.

Null texts stay null, empty ones empty, and what is no entity stays byte for byte. Equal texts give equal results,
whatever their ids; null and repeated ids matter nothing. Texts are searched whole, whatever their length. Extra
columns pass through, but for n_entities, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.llm.kernel import fresh, stored

HONORIFICS = {"male": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"), "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"), "any": ("Dr", "Prof")}
GIVEN = {
    "male": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Hans", "Jürgen", "Klaus", "Pierre", "Jacques", "Carlos", "Miguel", "Иван", "Сергей", "Νίκος"),
    "female": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Ursula", "Monika", "Marie", "Camille", "Carmen", "Lucía", "Мария", "Ольга", "Ελένη"),
}
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}{1,30}(?:['’-]?\p{Lu}\p{Ll}{1,30})?"
_CAPITALS = r"\p{Lu}(?:['’-]?\p{Lu}){1,30}(?!\p{L})"
_LABEL = r"""(?:(?:token|password|passwd|secret|api_key|apikey|access_key) {0,3}[=:] {0,3}|(?:token|password|passwd|secret) is (?=[^\s"']*\d)|Bearer {1,3}(?=[^\s"']{16})(?=[^\s"']*\d))"""
#: Words after "my name is" that begin no name.
_NO_NAME = "(?!(?:a|an|the|not|on|in|of|my|your|very|also|still|just|now|so|too|never|spelled|spelt|pronounced|written|called|listed|missing|wrong|already|there|here|and|but|or|mentioned|given|known)\\b)"
_QUOTED = r"(?=[^{0}\r\n]{{8}})(?=[^{0}\r\n\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^{0}\r\n]++(?={0})"
_BARE = r"""(?=[^\s"']{8})(?=[^\s"'\p{L}\p{N}]*+[\p{L}\p{N}])(?:[.,;:!?)\]}>]*+[^\s"'.,;:!?)\]}>]++)++"""
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z])" + _LABEL + r"(?:\"" + _QUOTED.format('"') + "|'" + _QUOTED.format("'") + r"|[\"']?" + _BARE + ")",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(.+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\d-])"
    + r"|(?<![\d(.+-])(?<!\d )(?:[2-9]\d{2} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{4})(?![\d-]| \d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ip6": r"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?![\d-])",
    "name": r"(?=[A-ZА-ЯΑ-Ω])(?<!\p{L})(?:(?<=(?i:my name is|name:|signed,|regards,|dear) )" + _WORD + f"(?: {_WORD})?|(?<=(?i:attn|attn:|sincerely,|from:|author:|patient:|contact:|customer:) ){_WORD} {_WORD}|(?:" + "|".join(x for v in HONORIFICS.values() for x in v) + rf")\.? (?:{_WORD}(?: {_WORD})?|{_CAPITALS}(?: {_CAPITALS})?)|(?:" + "|".join(x for v in GIVEN.values() for x in v) + f") {_WORD}|(?:" + "|".join(x.upper() for v in GIVEN.values() for x in v) + rf") {_CAPITALS}|{_WORD} {_WORD}(?= ?[<(][\w.%+-]{{1,64}}@))"
    + rf"|(?<=(?:my|My) name is ){_NO_NAME}\p{{Ll}}{{2,30}}(?: {_NO_NAME}\p{{Ll}}{{2,30}})?(?!\p{{L}})",
}
ENTITY = "|".join(PATTERNS.values())
#: Texts without any of these can hold names only: every other pattern needs one of them.
MARKS = r"[@=:\d]|AKIA|gh[pousr]_"
#: Country codes of the dialling plan (fixed values): those of one and two digits, else three; or a trunk 0.
DIALLED = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|^0"
KEY = "spark.metricmart.pii.key"
_SYLLABLES = {"Latin": ("bdfgklmnprstvzhj", "aeio"), "Cyrillic": ("бвгдзклмнпрстфхж", "аеио"), "Greek": ("βγδζθκλμνπρστφχψ", "αειο")}
_ENDINGS = {"Latin": {"male": "us", "female": "a"}, "Cyrillic": {"male": "ан", "female": "ия"}, "Greek": {"male": "ος", "female": "ία"}}


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for k in reversed([k for k in PATTERNS if k != "name"]):
        # no other kind begins like a secret, whose end depends on what follows it in the text
        out = F.when(entity.rlike("^" + _LABEL if k == "secret" else "^(?:" + PATTERNS[k] + ")$"), F.lit(k)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


TITLE = "^(?:" + "|".join(x for v in HONORIFICS.values() for x in v) + r")\.? "


def units(entity: Column, k: Column) -> Column:
    """What is kept distinct, as an array of canonical forms: a secret without its label, the words of a name (with the
    gender of a given name), an address and its domain, else the entity. Each begins with its kind; ``k``: the entity's."""
    secret = F.regexp_replace(entity, "^" + _LABEL + r"[\"']?", "")
    named = lambda words: F.transform(words, lambda w, i: F.concat(F.lit("name:"), _gender(F.lower(w), i, F.size(words), entity), F.lit(":"), F.lower(w)))
    one = lambda kind, value: F.array(F.concat(F.lit(f"{kind}::"), value))
    mail, digits = F.lower(entity), F.regexp_replace(F.regexp_replace(entity, r"\(0\)", ""), "[^0-9]", "")
    phone = F.when(F.startswith(entity, F.lit("+")), F.concat(F.lit("+"), digits)).when((F.length(digits) == 10) & ~F.startswith(digits, F.lit("0")), F.concat(F.lit("+1"), digits)).otherwise(digits)
    return (
        F.when(k == "name", named(F.split(F.regexp_replace(entity, TITLE, ""), " ")))
        .when(k == "secret", F.when(secret.rlike("^" + PATTERNS["access_key"] + "$"), one("access_key", secret)).otherwise(one("secret", secret)))
        .when(k == "email", F.array(F.concat(F.lit("email::"), mail), F.concat(F.lit("domain::"), F.substring_index(mail, "@", -1))))
        .when(k == "phone", one("phone", phone)).when(k == "card", one("card", digits)).when(k == "iban", one("iban", F.regexp_replace(entity, " ", ""))).when(k == "ip6", one("ip6", mail))
        .otherwise(F.array(F.concat(k, F.lit("::"), entity)))
    )


def _gender(word: Column, i: Column, n: Column, entity: Column) -> Column:
    """Of a known given name its own, of the first of two words its honorific's; surnames have none."""
    called = lambda g: entity.rlike("^(?:" + "|".join(HONORIFICS[g]) + r")\.? ")
    first = (i == 0) & (n > 1)
    known = {g: [x.lower() for x in v] for g, v in GIVEN.items()}
    return F.when(first & word.isin(*known["male"]), "male").when(first & word.isin(*known["female"]), "female").when(first & called("male"), "male").when(first & called("female"), "female").otherwise("any")


def _number(h: Column, i: Column | int) -> Column:
    """The i-th 16-bit number (from 0) of a hash of 128 hex digits, repeated beyond 32."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(32)) * 4 + 1
    return F.conv(F.substring(h, at, F.lit(4)), 16, 10).cast("int")


def _hash(key: str, what: str, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit(what), F.lower(value), attempt.cast("string")), 512)


def _scrambled(s: Column, h: Column, hexadecimal: bool = False, all_letters: bool = False) -> Column:
    """``h``: a column or variable that holds the hash. ``all_letters``: other alphabets and symbols change too."""

    def of(s: Column) -> Column:
        def char(i: Column) -> Column:
            def pick(c: Column) -> Column:
                one = lambda letters: F.substring(F.lit(letters), (_number(h, i - 1) + i + F.floor(i / 32) * 7) % len(letters) + 1, F.lit(1))
                if hexadecimal:
                    return F.when(c.rlike("[0-9a-f]"), one("0123456789abcdef")).otherwise(c)
                made = F.when(c.rlike("[0-9]"), one("0123456789")).when(c.rlike("[a-z]"), one("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), one("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                if all_letters:
                    made = made.when(c.rlike(r"\p{Lu}"), one("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"[\p{L}\p{M}]"), one("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"\p{N}"), one("0123456789")).when(c.rlike(r"[!@#$%^&*?~]|[^\x00-\x7f]"), one("!@#$%^&*?~"))
                return made.otherwise(c)

            return let(F.substring(s, i, F.lit(1)), pick)

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), char), "")).otherwise(F.lit(""))

    return let(s, of)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last is the check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(v: Column, h: Column) -> Column:
    def fixed(new: Column) -> Column:
        open_sum = luhn_sum(F.concat(F.substring(new, F.lit(1), F.length(new) - 1), F.lit("0")))
        return F.when(luhn_sum(v) % 10 == 0, F.concat(F.substring(new, F.lit(1), F.length(new) - 1), ((10 - open_sum % 10) % 10).cast("string"))).otherwise(new)

    return let(F.concat(F.substring(v, F.lit(1), F.lit(1)), _scrambled(F.substring(v, F.lit(2), F.length(v) - 1), h)), fixed)


def _name_word(w: Column, h: Column, n: Column, gender: Column) -> Column:
    """A made-up word of ``w``'s script, in small letters; further attempts (``n``) make it longer."""
    out = None
    for s, (c, v) in _SYLLABLES.items():
        pick = lambda letters, i: F.substring(F.lit(letters), _number(h, i) % len(letters) + 1, F.lit(1))
        first, rest = pick(c, 0), [pick(c if i % 2 == 0 else v, i) for i in range(1, 8)]
        more = F.array_join(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(8))), lambda i: F.when(i == 0, "").otherwise(F.concat(pick(c, 2 * i + 8), pick(v, 2 * i + 9)))), "")
        tail = F.when(gender == "male", F.lit(_ENDINGS[s]["male"])).when(gender == "female", F.lit(_ENDINGS[s]["female"])).otherwise(F.lit(""))
        made = F.concat(first, *rest, more, tail)
        out = made if out is None else F.when(w.rlike(rf"\p{{Is{s}}}"), made).otherwise(out)
    return out


def _more(h: Column, n: Column, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> Column:
    """Nothing for the first four attempts, then more and more letters."""
    return F.when(n < 4, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substring(F.lit(letters), _number(h, i + 20) % len(letters) + 1, F.lit(1))), ""))


def _email(v: Column, h: Column, n: Column) -> Column:
    """A new local part at the old domain, which is a unit of its own."""
    return F.concat(_scrambled(F.substring_index(v, "@", 1), h), _more(h, n), F.lit("@"), F.substring_index(v, "@", -1))


def _domain(v: Column, h: Column, n: Column) -> Column:
    """A name under a reserved domain, of the same top level where that has one."""
    top = F.substring_index(v, ".", -1)
    under = F.regexp_replace(v, r"(?:(?:^|\.)example)?\.[a-z]+$", "")
    suffix = F.when(top.isin("com", "net", "org"), F.concat(F.lit(".example."), top)).otherwise(F.lit(".example"))
    return F.concat(_scrambled(F.when(under == "", F.lit("site")).otherwise(under), h), _more(h, n), suffix)


def _mod97(s: Column) -> Column:
    """Of an IBAN whose country and check digits stand at the end; letters count as 10 to 35."""

    def add(total: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (total * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(v: Column, h: Column) -> Column:
    after = lambda s, k: F.substring(s, F.lit(k), F.length(s))
    good = _mod97(F.concat(after(v, 5), F.substring(v, 1, 4))) == 1

    def fixed(new: Column) -> Column:
        check = 98 - _mod97(F.concat(after(new, 5), F.substring(new, 1, 2), F.lit("00")))
        return F.when(good, F.concat(F.substring(new, 1, 2), F.lpad(check.cast("string"), 2, "0"), after(new, 5))).otherwise(new)

    return let(F.concat(F.substring(v, 1, 2), _scrambled(after(v, 3), h)), fixed)


def unit_surrogate(u: Column, attempt: Column, key: str) -> Column:
    """Replacement of one unit (see ``units``), without its kind; ``attempt`` is a number that changes it."""

    def of(k: Column, gender: Column, v: Column, n: Column, h: Column) -> Column:
        secret = F.concat(F.when(v.rlike("^[0-9a-f]+$"), _scrambled(v, h, True)).otherwise(_scrambled(v, h, all_letters=True)), _more(h, n, "0123456789abcdef"))
        base32 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), _number(h, i) % 32 + 1, F.lit(1))), "")
        country = F.regexp_extract(v, DIALLED, 0)
        prefixed = F.when(F.startswith(v, F.lit("AKIA")), F.concat(F.lit("AKIA"), base32)).otherwise(F.concat(F.substring(v, 1, 4), _scrambled(F.substring(v, F.lit(5), F.length(v)), h)))
        phone = F.concat(country, _scrambled(F.substring(v, F.length(country) + 1, F.length(v)), h))
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _number(h, i) % 254).cast("string")), ".")
        return (
            F.when(k == "email", _email(v, h, n)).when(k == "domain", _domain(v, h, n)).when(k == "secret", secret).when(k == "access_key", prefixed).when(k == "ip6", _scrambled(v, h, True)).when(k == "iban", _iban(v, h))
            .when(k == "phone", phone).when(k == "ip", ip).when(k == "card", _card(v, h)).when(k == "ssn", _scrambled(v, h)).otherwise(_name_word(v, h, n, gender))
        )

    kind_, gender = F.substring_index(u, ":", 1), F.element_at(F.split(u, ":", 3), 2)
    value = F.element_at(F.split(u, ":", 3), 3)
    return let(value, lambda v: let(F.coalesce(attempt, F.lit(0)), lambda n: let(_hash(key, "entity", v, n), lambda h: of(kind_, gender, v, n, h))))


def _laid(entity: Column, made: Column, sign: str) -> Column:
    """``entity`` with its signs replaced by the last ones of ``made``; what lies between them stays."""

    def fill(gaps: Column, signs: Column) -> Column:
        last = F.slice(signs, F.size(signs) - F.size(gaps) + 2, F.size(gaps) - 1)
        return F.array_join(F.zip_with(gaps, last, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(F.split(entity, sign, -1), lambda gaps: let(F.regexp_extract_all(made, F.lit(sign), F.lit(0)), lambda signs: fill(gaps, signs)))


def written_like(e: Column, k: Column, bare: Column, made: Column) -> Column:
    """The replacements of an entity's units the way the entity (without its title: ``bare``) is written."""
    cased = lambda w, m: F.when(w == F.lower(w), m).when((w == F.upper(w)) & (F.length(w) > 1), F.upper(m)).otherwise(F.initcap(m))
    mail = F.concat(F.substring_index(made[0], "@", 1), F.lit("@"), made[1])
    capitals = lambda m: F.when(e == F.upper(e), F.upper(m)).otherwise(m)
    return (
        F.when(k == "name", F.array_join(F.zip_with(F.split(bare, " "), made, cased), " ")).when(k == "email", capitals(mail)).when(k == "ip6", capitals(made[0]))
        .when(k.isin("phone", "card"), _laid(e, made[0], r"[1-9]|(?<!\()0|0(?!\))")).when(k == "iban", _laid(e, made[0], "[A-Z0-9]")).otherwise(made[0])
    )


def surrogate(entity: Column, attempt, key: str) -> Column:
    """Replacement of one entity; ``attempt`` gives, of a unit, a number that changes it."""

    def of(e: Column, k: Column, us: Column) -> Column:
        title = F.when(k == "name", F.regexp_extract(e, TITLE, 0)).when(k == "secret", F.regexp_extract(e, "^" + _LABEL + r"[\"']?", 0)).otherwise(F.lit(""))
        made = F.transform(us, lambda u: unit_surrogate(u, attempt(u), key))
        return F.concat(title, let(made, lambda m: written_like(e, k, F.regexp_replace(e, TITLE, ""), m)))

    return let(entity, lambda e: let(kind(e), lambda k: let(units(e, k), lambda us: of(e, k, us))))


def _attempts(found: DataFrame, key: str, rounds: int) -> DataFrame:
    """``found``: distinct units. Returns unit, attempt for those whose first replacement collides."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.element_at(F.split("unit", ":", 3), 3)
    made = lambda df: stored(df.repartition(parts, "unit").withColumn("made", unit_surrogate(F.col("unit"), F.col("attempt"), key)))
    now = made(found.select("unit", F.lit(0).alias("attempt")))
    real = now.select(value.alias("made")).distinct()
    for _ in range(rounds):
        # two units of one value but another gender are one entity
        shared = now.groupBy("made").agg(F.min(F.struct(value, "unit")).alias("first"), F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high").select("made", "low")
        again = now.join(shared, "made").where(value != F.col("low")).select("unit", "attempt")
        again = stored(again.union(now.join(real, "made", "left_semi").select("unit", "attempt")).distinct())
        if again.isEmpty():
            return now.where("attempt > 0").select("unit", "attempt")
        redrawn = made(again.select("unit", (F.col("attempt") + 1).alias("attempt")))
        now = stored(now.join(again.select("unit"), "unit", "left_anti").unionByName(redrawn))
    raise RuntimeError(f"entities of a crowded format still share surrogates after {rounds} rounds")


def entities(text: Column, marked: Column) -> Column:
    """All entities of a text, in order. ``marked``: whether it holds one of ``MARKS``."""
    return F.when(marked, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)))


def between(text: Column, marked: Column) -> Column:
    """The parts of a text between its entities: cut by the very pattern that found them."""
    return F.when(marked, F.split(text, ENTITY, -1)).otherwise(F.split(text, PATTERNS["name"], -1))


def session_key(spark: SparkSession) -> str:
    """The configured key, else one drawn for this session."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def replace_entities(docs: DataFrame, key: str | None = None, rounds: int = 100) -> DataFrame:
    """All columns of ``docs`` with entities in ``text`` replaced, and n_entities."""
    key = key or session_key(docs.sparkSession)
    keys = lambda text: (F.xxhash64(text), F.xxhash64(F.lit(1), text))
    one, two = keys(F.col("text"))
    marked = F.col("text").rlike(MARKS)
    found = docs.where("text is not null").select(one.alias("one"), two.alias("two"), F.explode(entities(F.col("text"), marked)).alias("entity"))
    found = stored(found.select("one", "two", F.explode(let(F.col("entity"), lambda e: let(kind(e), lambda k: units(e, k)))).alias("unit")).distinct())
    again = _attempts(found.select("unit").distinct(), key, rounds)
    kept = [c for c in docs.columns if c not in ("n_entities",)]
    one_, two_, attempts, found_, marked_ = (fresh(docs, x) for x in ("_one", "_two", "_attempts", "_found", "_marked"))
    changed = stored(found.join(again, "unit").groupBy(F.col("one").alias(one_), F.col("two").alias(two_)).agg(F.map_from_entries(F.collect_set(F.struct("unit", "attempt"))).alias(attempts)))
    out = docs.select(kept)
    if changed.isEmpty():
        out, attempt = out.withColumn(marked_, marked), lambda u: F.lit(0)
    else:
        out = out.join(changed, (one == F.col(one_)) & (two == F.col(two_)), "left").withColumn(marked_, marked)
        attempt = lambda u: F.coalesce(F.col(attempts)[u], F.lit(0))
    out = out.withColumn(found_, entities(F.col("text"), F.col(marked_)))
    made = F.transform(found_, lambda e: surrogate(e, attempt, key))
    text = F.when(F.size(found_) > 0, F.array_join(F.zip_with(between(F.col("text"), F.col(marked_)), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in kept], F.greatest(F.size(found_), F.lit(0)).alias("n_entities"))
