"""Surrogates for personal data; only DataFrame functions.

Patterns find e-mail addresses, account and card numbers, phone numbers, addresses of hosts, and names behind a title (one
to five parts besides initials; not parts all in capitals or small letters), and in the same document every further
mention of such a name as a whole word, as written or in capitals, whatever else the word may mean there. Each
entity gets a surrogate from a keyed hash of its kind and canonical form, so equal entities get equal surrogates in every
document, in any spelling, without looking at other documents. Surrogates keep type and format: digits for digits with
their separators, letters of the same script and case, a leading country digit, a valid check digit where there was one,
given names with an ending of the same gender (that of the title, else of the name), e-mail domains below ``.example``, equal for equal domains.

Distinctness is checked over the whole corpus: the distinct entities are collected in a table, and where two of one kind get
one surrogate, or a surrogate is itself an entity of the corpus, all but the least one try again with the next attempt
number, until no conflict is left. Documents work with attempt 0 on their own; only the entities with a later attempt are
joined back, by documents that hold one, and Spark broadcasts that table only if its size allows.

Defined results: null texts stay null and empty ones empty, both without entities; rows with equal or null ids are treated
alike. The patterns are anchored at the begin of a word or number and take it possessively, so long texts are scanned in
linear time. Extra columns stay outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import require, stored

#: Titles before names, by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Signor", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Signora", "госпожа", "г-жа"),
    "n": ("Dr", "Doctor", "Prof", "Professor"),
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_NATIONAL = r"(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
_DIGIT = r"\d[ .()-]{0,2}"  # written out n times below, as Java bounds no repeated group behind
#: A phone number ends before a card number and, from seven digits on, before another entity that begins with digits.
_ENDS = rf"(?!\d{{4}}(?:[ -]\d{{4}}){{3}}(?![ -]?\d))(?!(?<={_DIGIT * 7})(?:{_IP}|{_SSN}|{_NATIONAL}))"
#: A part of a name (hyphens, apostrophes and inner capitals allowed, not all capitals), initials, and a part after initials.
_NAME = r"(?=[\p{L}\p{M}'’-]*\p{Ll})\p{Lu}[\p{L}\p{M}]*(?:['’]\p{Lu}[\p{L}\p{M}]+|-\p{L}[\p{L}\p{M}]*)*"
_INITIAL = r"(?:(?:\p{L}\.)+|\p{L})"
_FULL = rf"(?:(?=\p{{Lu}}){_INITIAL} )*{_NAME}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": _IP,
    # ten digits after +1; elsewhere groups, at most 15 digits in all; national forms
    "phone": r"(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|(?<![\d+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?{_ENDS}\d{{2,4}}){{1,4}}(?!\d)(?<!{_DIGIT * 15}\d)"
    rf"|{_NATIONAL}",
    "ssn": _SSN,
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_FULL}(?: {_FULL}){{0,4}}(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: The syllables of invented names, and letters of a script in alphabetic order.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se so ta te to va ve vo",
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то ва ве во",
    "greek": "βα βε βο δα δε δο γα γο κα κε κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε σο τα τε το",
}
_ENDINGS = {
    ("latin", "given_m"): "n", ("latin", "given_f"): "lia", ("latin", "family"): "rd",
    ("cyrillic", "given_m"): "н", ("cyrillic", "given_f"): "ля", ("cyrillic", "family"): "ренко",
    ("greek", "given_m"): "ς", ("greek", "given_f"): "λια", ("greek", "family"): "κης",
}
_LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}


def kind_of(found: Column) -> Column:
    """The kind of a match, by the first pattern that takes all of it."""
    out = F.when(F.contains(found, F.lit("@")), "email")
    for kind, pattern in PATTERNS.items():
        if kind not in ("email", "name"):
            out = out.when(found.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("name")  # with or without title


def _title_gender(found: Column) -> Column:
    title = F.regexp_extract(found, rf"^({_TITLE})\.? ", 1)
    by_name = F.when(F.element_at(_name_parts(found), 1).rlike("[aàáäâяα]$"), "given_f").otherwise("given_m")
    return F.when(title.isin(*TITLES["m"]), "given_m").when(title.isin(*TITLES["f"]), "given_f").otherwise(by_name)


def _name_parts(found: Column) -> Column:
    return F.split(F.regexp_replace(found, rf"^(?:{_TITLE})\.? ", ""), " ")


def entities_of(found: Column, kind: Column) -> Column:
    """The entities in a match, as an array of ``kind, canonical``: one, or initials, given names and a family name."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    canonical = (
        F.when(kind == "email", F.lower(found))
        .when(kind == "ip", found)
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .otherwise(digits)
    )
    parts = _name_parts(found)
    entity = lambda k, v: F.struct(k.alias("kind"), v.alias("canonical"))
    given = _title_gender(found)

    def named(part: Column, place: Column) -> Column:
        sort = F.when(part.rlike(f"^{_INITIAL}$"), "initial").when(place == F.size(parts) - 1, "family").otherwise(given)
        return entity(sort, F.lower(part))

    names = F.transform(parts, named)
    return F.when(kind == "name", names).otherwise(F.array(entity(kind, canonical)))


def _pick(choices: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))


def _like(char: Column, number: Column) -> Column:
    """A character of the same class: digit, or letter of the same script and case; others stay."""
    letter = F.substring(F.lit(_LETTERS["latin"]), 1, 1)
    for script in ("latin", "cyrillic", "greek"):
        letters = _LETTERS[script]
        one = F.lit(letters).substr((F.pmod(number, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        letter = one if script == "latin" else F.when(char.rlike(_SCRIPTS[script]), one).otherwise(letter)
    return (
        F.when(char.rlike("[0-9]"), F.pmod(number, F.lit(10)).cast("string"))
        .when(char.rlike(r"\p{Lu}"), F.upper(letter))
        .when(char.rlike(r"\p{L}"), letter)
        .otherwise(char)
    )


def _mapped(value: Column, seed: Column, kept: Column) -> Column:
    """The value with all but its first ``kept`` characters replaced by others of their class."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(i < kept, c).otherwise(_like(c, F.xxhash64(seed, i)))), "")


def luhn_sum(digits: Column) -> Column:
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(chars, weight), F.lit(0), lambda a, b: a + b)


def _checked(digits: Column, like: Column) -> Column:
    """The digits with a last digit that makes them valid, if those of ``like`` are."""
    front = digits.substr(F.lit(1), F.length(digits) - 1)
    last = F.pmod(10 - luhn_sum(F.concat(front, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(luhn_sum(like) % 10 == 0, F.concat(front, last)).otherwise(digits)


def iban_remainder(iban: Column) -> Column:
    """What is left of an IBAN by 97: 1 if its check digits are right. Letters count as two digits, the front four go last."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def on(left: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, (left * 10 + F.ascii(c) - 48) % 97).otherwise((left * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), on)


def _checked_iban(iban: Column, like: Column) -> Column:
    """The IBAN with check digits that make it valid, if those of ``like`` are."""
    country, rest = iban.substr(F.lit(1), F.lit(2)), iban.substr(F.lit(5), F.length(iban))
    digits = F.lpad((98 - iban_remainder(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(iban_remainder(like) == 1, F.concat(country, digits, rest)).otherwise(iban)


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canonical, attempt.cast("string")).cast("binary"), 256)
    number = lambda k: F.xxhash64(seed, k if isinstance(k, Column) else F.lit(k))
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    host = F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), domain).cast("binary"), 256), 1, 10)
    octet = lambda k: (F.pmod(number(k), F.lit(254)) + 1).cast("string")
    out = (
        F.when(kind == "email", F.concat(_mapped(local, seed, F.lit(0)), F.lit("@d"), host, F.lit(".example")))
        .when(kind == "ip", F.concat_ws(".", *(octet(k) for k in range(4))))
        .when(kind == "iban", _checked_iban(_mapped(canonical, seed, F.lit(2)), canonical))
        .when(kind == "card", _checked(_mapped(canonical, seed, F.lit(1)), canonical))
        .when(kind == "phone", _mapped(canonical, seed, F.lit(1)))
        .when(kind.isin("ssn", "initial"), _mapped(canonical, seed, F.lit(0)))
    )
    for script in ("cyrillic", "greek", "latin"):
        syllables = _SYLLABLES[script].split()
        # one syllable more with each attempt, so invented names never run out
        stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt.cast("int") + 2), lambda k: _pick(syllables, number(k))), "")
        for (s, k), ending in _ENDINGS.items():
            if s == script:
                fits = kind == k if script == "latin" else (kind == k) & canonical.rlike(_SCRIPTS[script])
                out = out.when(fits, F.concat(stem, F.lit(ending)))
    return out


def _poured(found: Column, value: Column, significant: str) -> Column:
    """The match with its significant characters replaced, in order, by those of the value; separators stay."""
    chars = F.filter(F.split(found, ""), lambda c: c != "")

    def put(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(found.substr(F.lit(1), i + 1), f"[^{significant}]", ""))
        return F.when(c.rlike(f"[{significant}]"), value.substr(place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def rendered(found: Column, kind: Column, values: Column) -> Column:
    """The surrogate values of a match in the format of the match."""
    value = F.element_at(values, 1)
    title = F.regexp_extract(found, rf"^((?:{_TITLE})\.? )", 1)
    cased = lambda v: F.when((found == F.upper(found)) | v.rlike(f"^{_INITIAL}$"), F.upper(v)).otherwise(F.initcap(v))
    return (
        F.when(kind == "email", F.when(found == F.upper(found), F.upper(value)).otherwise(value))
        .when(kind == "ip", value)
        .when(kind == "iban", _poured(found, value, "A-Z0-9"))
        .when(kind == "name", F.concat(title, F.array_join(F.transform(values, cased), " ")))
        .otherwise(_poured(found, value, "0-9"))
    )


def _entities(docs: DataFrame, text: str) -> Column:
    found = F.regexp_extract_all(docs[text], F.lit(PATTERN), F.lit(0))
    every = F.flatten(F.transform(found, lambda m: entities_of(m, kind_of(m))))
    return F.filter(every, lambda e: e["kind"] != "initial")


def _with_mentions(words: Column) -> Column:
    """The pattern of a document: all kinds, and the words of the names found in it, as written or in capitals."""
    written = F.sort_array(F.array_distinct(F.concat(words, F.transform(words, F.upper))), asc=False)  # longer ones before their beginnings
    mention = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(written, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(words) > 0, mention).otherwise(PATTERN)


def later_attempts(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """``kind, canonical, attempt`` of the entities (distinct kind, canonical) that cannot use attempt 0.

    Names get longer with each attempt and never run out. Other kinds keep their format, which holds a fixed number of values:
    an error is raised when the conflicts have not become fewer for ``most_rounds`` rounds.
    """
    real = entities.select(F.col("kind").alias("rkind"), F.col("canonical").alias("rvalue"))
    state = entities.select("kind", "canonical", F.lit(0).alias("attempt"))
    least, stuck = None, 0
    while stuck < most_rounds:
        now = state.withColumn("value", surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
        # names are words: another person of that name in the corpus is no conflict, only two that become one are
        taken = now.join(real, (now["kind"] == real["rkind"]) & (now["value"] == real["rvalue"]), "left_semi").filter(
            ~F.col("kind").isin("given_m", "given_f", "family")
        )
        shared = now.groupBy("kind", "value").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        shared = shared.select(F.col("kind").alias("skind"), F.col("value").alias("svalue"), F.col("first.canonical").alias("keeps"))
        beaten = now.join(shared, (now["kind"] == shared["skind"]) & (now["value"] == shared["svalue"])).filter("canonical <> keeps")
        losers = taken.select("kind", "canonical").unionAll(beaten.select("kind", "canonical")).distinct()
        losers = stored(losers.select(F.col("kind").alias("lkind"), F.col("canonical").alias("lcanonical")), "surrogate-conflicts")
        left = losers.count()
        if not left:
            return state.filter("attempt > 0")
        least, stuck = (left, 0) if least is None or left < least else (least, stuck + 1)
        met = state.join(losers, (state["kind"] == losers["lkind"]) & (state["canonical"] == losers["lcanonical"]), "left")
        state = stored(met.select("kind", "canonical", (F.col("attempt") + F.col("lkind").isNotNull().cast("int")).alias("attempt")), "attempts")
    raise RuntimeError("the surrogates that fit the format of some kind are used up")


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``row`` (all its columns), ``replaced`` (the new text), ``kinds`` of its entities."""
    require(docs, (text,))
    every = docs.select(F.explode(_entities(docs, text)).alias("e")).select("e.*")
    entities = stored(every.distinct(), "entities")
    later = stored(later_attempts(entities, key), "later-attempts")
    left = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].alias("text"))
    if later.isEmpty():
        left = left.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        holders = docs.select(F.xxhash64(docs[text]).alias("body"), F.explode(F.array_distinct(_entities(docs, text))).alias("e"))
        # by text, as equal texts hold equal entities
        held = holders.select("body", "e.*").distinct().join(later, ["kind", "canonical"])
        named = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "canonical"), "attempt")))
        attempts = stored(held.groupBy("body").agg(named.alias("attempts")), "attempts-of-texts")
        left = left.withColumn("body", F.xxhash64("text")).join(attempts, "body", "left")

    titled = F.coalesce(F.regexp_extract_all("text", F.lit(PATTERNS["name"]), F.lit(0)), F.array().cast("array<string>"))
    left = left.withColumn("titled", titled)
    parts = F.array_distinct(F.flatten(F.transform("titled", _name_parts)))
    words = F.filter(parts, lambda w: ~w.rlike(f"^{_INITIAL}$"))
    known = F.flatten(F.transform("titled", lambda m: entities_of(m, F.lit("name"))))
    left = left.withColumn("pattern", _with_mentions(words)).withColumn("known", known)

    def replacement(m: Column) -> Column:
        kind = kind_of(m)
        mention = (kind == "name") & ~m.rlike(f"^(?:{_TITLE})\\.? ")
        same = F.slice(F.filter("known", lambda e: (e["kind"] != "initial") & (e["canonical"] == F.lower(m))), 1, 1)
        entities = F.when(mention, same).otherwise(entities_of(m, kind))

        def value(e: Column) -> Column:
            attempt = F.coalesce(F.try_element_at("attempts", F.concat_ws("\u0001", e["kind"], e["canonical"])), F.lit(0))
            return surrogate(e["kind"], e["canonical"], attempt, key)

        return rendered(m, kind, F.transform(entities, value))

    found = left.withColumn("found", F.coalesce(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), F.array().cast("array<string>")))
    between = F.split("text", F.col("pattern"), -1)
    new = F.transform(F.col("found"), replacement)
    put = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), new.alias("n")), lambda z: F.array(z["b"], F.coalesce(z["n"], F.lit(""))))), "")
    return found.select(
        "row", F.when(F.size("found") == 0, F.col("text")).otherwise(put).alias("replaced"), F.transform("found", kind_of).alias("kinds")
    )
