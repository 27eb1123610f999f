"""Personal data replaced by surrogates.

Entities are found by patterns and named by kind and normal form, so that differently written mentions of one entity are one.
Names are found behind titles first; then all mentions of a document's names are taken, with and without title. A surrogate is
drawn from a keyed SHA-256 stream of the entity's name: the same entity gets the same surrogate everywhere, without a table of
secrets. It keeps the mention's kind and format: digits for digits, letters for letters in the same case and script, given names of
the same gender and with the letter that their initial gets, valid check digits for cards and IBANs, possible numbers for SSNs, private
addresses in their private range.

Distinctness is checked over the whole corpus: a surrogate that equals another entity's, or an entity that
occurs itself, is drawn again with the next attempt number. Only these few exceptions have to be joined to the
documents; all other surrogates are worked out where they are needed. All steps are built-in functions.

Texts are scanned once: a trace of an entity decides whether the patterns are tried at all, and what they find is written with the text
between. Where a text has titled names, its other words with a capital are looked up among them, in hashed maps. Every repetition in a pattern is bounded or possessive, so very long texts and words need no deep stack.
Not found are names that have a title nowhere in their document, street addresses, dates of birth and
numbers of kinds not listed here.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

MALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа"
NEUTRAL = "Dr|Dra|Prof|Professor|Doctor|Doctora|Docteur|Doktor|Д-р|Доктор|Профессор"
_TITLE = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
#: One word of a name: O'Brien, McDonald, Jean-Luc, SMITH.
_WORD = r"(?:(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}{1,24}){1,2}(?:-\p{Lu}\p{Ll}{1,24}){0,2}|\p{Lu}{2,25})(?!\p{L})"
_TITLED = rf"{_TITLE}(?:(?:(?:\p{{Lu}}\. ?|{_WORD} |(?:von|van|de|der|den|la|le|du|di|da|del|dos) )){{0,4}}){_WORD}"
_LABEL = r"(?i:token|secret|password|passwd|api[_-]?key)"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9\-])",
    "secret": rf"(?<=\")(?<={_LABEL} ?[=:] ?\")[A-Za-z0-9+/=_\-]{{8,}}+(?=\")|(?<=[=: ])(?<={_LABEL} ?[=:] ?)(?=[^\s\"',;\d]{{0,200}}+\d)[^\s\"',;]{{6,}}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{1,4}:[A-Fa-f:]{0,30}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{2,4}(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![\d.])(?:(?:\d{4}[ \-]?){3}\d{4}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ \-]?(?:\(\d{1,4}\)[ \-]?)?\d{2,4}(?:[ \-](?!\d{4}-\d\d-\d\d)\d{2,4}){1,4}(?!\d|[:/]\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
}
#: What a text with an entity holds at least; most texts don't, and are seen through fast.
TRACE = rf"@[A-Za-z0-9\-]{{1,64}}+\.|\d[\d ().\-]{{5}}|[A-Z]{{2}}\d\d ?[A-Z0-9]{{4}}|{_LABEL} ?[=:]|[0-9A-Fa-f]:[0-9A-Fa-f:]"
TITLE_TRACE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The same, and what could be a word of a name or an initial before one.
ANY_OR_NAME = rf"{ANY}|(?<!\p{{L}}){_WORD}|(?<!\p{{L}})\p{{Lu}}\.(?= ?(?:\p{{Lu}}\. ?)?\p{{Lu}})"
_SEP = "\x1f"
GIVEN = ("given_m", "given_f", "given_n")
NAMES = (*GIVEN, "surname", "initial")
KINDS = (*PATTERNS, *NAMES)
ROUNDS = 12
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу")}
_ENDS = {"given_m": ("n", "н"), "given_f": ("na", "на"), "given_n": ("is", "ис"), "surname": ("ler", "лер")}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
#: First numbers of public addresses.
_PUBLIC = [i for i in range(1, 224) if i not in (10, 127, 169, 172, 192)]
_MENTIONS = "array<struct<m:string,kind:string,norm:string>>"
_MAP = "array<struct<kind:string,norm:string,s:string>>"


def _bind(x: Column, f) -> Column:
    """``f`` of ``x``, which is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _names(t: Column) -> Column:
    """array<string>: of each word of the names behind the titles of a text, in lower case, its kind behind a separator; sorted, a word once (as a given
    name, if it is both). A part of a hyphened word is a word too, where the whole one isn't found."""

    def words(m: Column) -> Column:
        kind = F.when(m.rlike(rf"\A(?:{MALE})\.? "), "given_m").when(m.rlike(rf"\A(?:{FEMALE})\.? "), "given_f").otherwise("given_n")
        parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(m, rf"\A{_TITLE}", ""), r"\. ?", ". "), " "), lambda w: w.rlike(rf"\A{_WORD}\z") & ~w.rlike(rf"\A(?:{MALE}|{FEMALE}|{NEUTRAL})\z"))
        of = lambda w, i: F.when(i == F.size(parts) - 1, "surname").otherwise(kind)
        own = F.transform(parts, lambda w, i: F.transform(F.array_distinct(F.concat(F.array(w), F.split(w, "-"))), lambda p: F.concat(F.lower(p), F.lit(_SEP), of(w, i))))
        return F.flatten(own)

    none = F.expr("cast(array() as array<string>)")
    found = F.when(t.rlike(TITLE_TRACE), F.sort_array(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(_TITLED), F.lit(0)), words))))).otherwise(none)
    word = lambda x: F.substring_index(x, _SEP, 1)
    return _bind(found, lambda all_of: F.filter(all_of, lambda x, i: (i == 0) | (word(F.get(all_of, i - 1)) != word(x))))


def _buckets(names: Column) -> Column:
    """The names as maps from word to kind, one for each of so many hashes that a look-up goes through about the root of their number."""
    n = F.ceil(F.sqrt(F.size(names))).cast("int")
    hashed = F.transform(names, lambda x: F.struct(F.pmod(F.xxhash64(F.substring_index(x, _SEP, 1)), n).alias("h"), F.substring_index(x, _SEP, 1).alias("w"), F.substring_index(x, _SEP, -1).alias("k")))
    return F.when(F.size(names) > 0, _bind(hashed, lambda h: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.map_from_entries(F.transform(F.filter(h, lambda x: x["h"] == b), lambda x: F.struct(x["w"], x["k"]))))))


def found(text: Column) -> Column:
    """struct(e: array of (m, kind, norm), gaps: the pieces of text around them) of a text; null for one without entities.

    In a text with names all words that could be names are looked up among them; those that are none have the kind ``none``, and stay."""
    t = F.coalesce(text, F.lit(""))

    def kind_of(w: Column, buckets: Column) -> Column:
        return F.try_element_at(F.get(buckets, F.pmod(F.xxhash64(w), F.size(buckets)).cast("int")), w)

    def one(m: Column, before: Column, buckets: Column) -> Column:
        low = F.lower(m)
        kind = F.coalesce(kind_of(low, buckets), F.when(m.rlike(r"\A\p{Lu}\.\z"), "initial"))
        other = (
            F.when(m.rlike(r"\A[^@]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"), "email")
            .when(F.coalesce(before, F.lit("")).rlike(rf'{_LABEL} ?[=:] ?"?\z'), "secret")
            .when(m.rlike(rf"\A{_WORD}\z"), "none")
            .when(m.contains(":"), "ipv6")
            .when(m.contains("."), "ip")
            .when(m.rlike(r"\A(?:\d[ \-]?){15,16}\z") & ~m.rlike(r"\A\+"), "card")
            .when(m.rlike(r"\A\d{3}-\d{2}-\d{4}\z"), "ssn")
            .when(m.rlike(r"\A[+(\d]"), "phone")
            .otherwise("iban")
        )
        kind = F.coalesce(kind, other)
        norm = F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, r"\D", "")).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "secret", m).otherwise(low)
        return F.struct(F.coalesce(before, F.lit("")).alias("gap"), m.alias("m"), kind.alias("kind"), norm.alias("norm"))

    def in_parts(x: Column, buckets: Column) -> Column:
        """A hyphened word that is no name, by its parts."""
        part = lambda p, i: F.struct(F.when(i == 0, x["gap"]).otherwise("").alias("gap"), p.alias("m"), F.coalesce(kind_of(F.lower(p), buckets), F.lit("none")).alias("kind"), F.lower(p).alias("norm"))
        return F.when((x["kind"] == "none") & x["m"].rlike("[-'’]"), F.transform(F.split(x["m"], "(?<=[-'’])|(?=[-'’])"), part)).otherwise(F.array(x))

    def settled(e: Column) -> Column:
        """Initials stay, unless a name follows, or another initial and a name."""
        at = lambda i: F.get(e, i)
        close = lambda i: at(i)["gap"].isin("", " ")
        name = lambda i: at(i)["kind"].isin(*GIVEN, "surname")
        led = lambda i: F.coalesce(close(i + 1) & (name(i + 1) | (at(i + 1)["kind"] == "initial") & close(i + 2) & name(i + 2)), F.lit(False))
        return F.transform(e, lambda x, i: F.struct(x["m"].alias("m"), F.when((x["kind"] == "initial") & ~led(i), "none").otherwise(x["kind"]).alias("kind"), x["norm"].alias("norm")))

    def cut(x: Column) -> Column:
        pieces = F.struct(F.regexp_extract_all(t, x["p"], F.lit(0)).alias("ms"), F.split(t, x["p"], -1).alias("gaps"), x["buckets"].alias("buckets"))
        tokens = lambda y: F.flatten(F.transform(F.transform(y["ms"], lambda m, i: one(m, F.get(y["gaps"], i), y["buckets"])), lambda z: in_parts(z, y["buckets"])))
        return _bind(pieces, lambda y: _bind(tokens(y), lambda e: F.struct(settled(e).alias("e"), F.concat(F.transform(e, lambda z: z["gap"]), F.array(F.element_at(y["gaps"], -1))).alias("gaps"))))

    all_of = _bind(_names(t), lambda names: _bind(F.struct(F.when(F.size(names) > 0, ANY_OR_NAME).otherwise(ANY).alias("p"), _buckets(names).alias("buckets")), cut))
    traced = F.when(t.rlike(TRACE) | t.rlike(TITLE_TRACE), all_of)
    return F.when(F.exists(traced["e"], lambda x: x["kind"] != "none"), traced)


def _digits(s: Column) -> Column:
    return F.transform(F.split(s, "(?!\\A)(?!\\z)"), lambda c: F.ascii(c) - 48)


def luhn(s: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number (a string of digits)."""
    two = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.reverse(_digits(s)), lambda d, i: F.when(i % 2 == 1, two(d)).otherwise(d)), F.lit(0), lambda a, d: a + d)


def mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, a letter as 10 to 35."""
    codes = F.transform(F.split(s, "(?!\\A)(?!\\z)"), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c > 57, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def _rotated(key: str, script: str) -> tuple[str, str]:
    letters = _LETTERS[script]
    n = int(hashlib.sha256(f"{key}\x1finitial\x1f{script}".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
    return letters, letters[n:] + letters[:n]


def rotated(c: Column, key: str) -> Column:
    """An initial's surrogate: another letter of the alphabet, by a key-dependent rotation."""
    for script in _LETTERS:
        a, b = _rotated(key, script)
        c = F.translate(c, a + a.upper(), b + b.upper())
    return c


def draw(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """The surrogate's normal form: as long as ``norm`` but for addresses and names."""
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 16).cast("int") + 1), lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), b.cast("string")), 256)), "")

    def built(x: Column) -> Column:
        byte = lambda i: F.conv(F.substring(x["h"], i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        number = lambda i: F.conv(F.substring(x["h"], F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")
        norm, kind = x["n"], x["k"]
        pick = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        last = F.instr(F.reverse(norm), ".")
        hexadecimal = (kind == "ipv6") | (kind == "secret") & norm.rlike(r"\A[0-9a-f]+\z")

        def char(c: Column, i: Column) -> Column:
            kept = (
                ((kind == "email") & ((i >= F.length(norm) - last) | ~c.rlike("[a-z0-9]"))) | ((kind == "phone") & (i == 0)) | ((kind == "card") & ((i == 0) | ((i == 1) & norm.startswith("3"))))
                | ((kind == "iban") & (i < 4)) | ((kind == "ipv6") & (i < F.instr(norm, ":")))
            )
            return (
                F.when(kept, c)
                .when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef", byte(i)))
                .when(c.rlike("[0-9]"), pick("0123456789", byte(i)))
                .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", byte(i)))
                .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte(i)))
                .otherwise(c)
            )

        chars = F.array_join(F.transform(F.split(norm, "(?!\\A)(?!\\z)"), char), "")

        def card(s: Column) -> Column:
            body = F.substring(s, F.lit(1), F.length(s) - 1)
            check = F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10))
            return F.when(luhn(norm) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(s)

        def iban(s: Column) -> Column:
            country, body = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s))
            check = F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, body)

        area = number(0) % 897 + 1
        ssn = F.concat(F.lpad((area + (area >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((number(1) % 99 + 1).cast("string"), 2, "0"), F.lpad((number(2) % 9999 + 1).cast("string"), 4, "0"))
        old = F.split(norm, r"\.")
        fresh = [F.element_at(F.array(*map(F.lit, _PUBLIC)), (number(0) % len(_PUBLIC) + 1).cast("int")).cast("string"), *[(number(i) % 254 + 1).cast("string") for i in (1, 2, 3)]]
        own = F.when(norm.rlike(r"\A(?:10|127)\."), 1).when(norm.rlike(r"\A(?:192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\."), 2).otherwise(0)  # private ranges stay
        ip = F.concat_ws(".", *[F.when(F.lit(i) < own, F.get(old, F.lit(i))).otherwise(f) for i, f in enumerate(fresh)])

        def name(script: str, place: int) -> Column:
            onset, vowel = _SYLLABLES[script]
            plain, turned = _rotated(key, script)

            def part(p: Column, at: Column) -> Column:
                """One part of a hyphenated name: its initial's letter, then syllables."""
                n = F.lit(1) + byte(at + 12) % 2 + F.floor(x["a"] / 3).cast("int")  # longer where shorter ones are taken
                body = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(pick(onset, byte(at + (i * 2) % 24)), pick(vowel, byte(at + (i * 2 + 1) % 24)))), "")
                apostrophe = F.regexp_extract(p, r"\A\p{L}(['’])", 1)
                first = F.translate(F.substring(p, 1, 1), plain, turned)
                led = F.when(apostrophe != "", F.concat(first, apostrophe, pick(onset, byte(at + 8)))).otherwise(first)
                return F.concat(led, pick(vowel, byte(at)), body, pick(onset, byte(at + 10)), pick(vowel, byte(at + 9)))

            end = F.coalesce(*[F.when(kind == k, e[place]) for k, e in _ENDS.items()])
            return F.concat(F.array_join(F.transform(F.split(norm, "-"), lambda p, i: part(p, i * 7 % 20)), "-"), end)

        names = F.when(norm.rlike(r"\p{IsCyrillic}"), name("cyrillic", 1)).otherwise(name("latin", 0))
        return (
            F.when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "initial", rotated(norm, key)).when(kind.isin(*NAMES), names)
            .when(kind == "card", _bind(chars, card)).when(kind == "iban", _bind(chars, iban)).otherwise(chars)
        )

    return _bind(F.struct(stream.alias("h"), norm.alias("n"), kind.alias("k"), attempt.cast("int").alias("a")), built)


def placeholder(kind: Column, norm: Column, key: str) -> Column:
    """What an entity gets whose format has no free surrogate left: its kind and a keyed hash."""
    return F.concat(F.lit("["), kind, F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("placeholder"), kind, norm), 256), 1, 20), F.lit("]"))


def dressed(m: Column, kind: Column, s: Column) -> Column:
    """The surrogate ``s`` in the format of the mention ``m``: its separators and case."""
    chars = F.split(m, "(?!\\A)(?!\\z)")

    def spread(is_part: str, skipped: str) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), skipped, ""))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(is_part), F.substring(s, place(i), F.lit(1))).otherwise(c)), "")

    upper = (m == F.upper(m)) & (m != F.lower(m))
    capital = F.array_join(F.transform(F.split(s, "(?<=[-'’])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    return (
        F.when(s.startswith("["), s)
        .when(kind.isin("card", "phone", "ssn"), spread(r"\d", r"\D"))
        .when(kind == "iban", spread("[^ ]", " "))
        .when(kind == "secret", s)
        .when(upper, F.upper(s))
        .when(kind.isin(*NAMES), capital)
        .otherwise(s)
    )


def exceptions(known: DataFrame, key: str, most_rounds: int = ROUNDS) -> DataFrame:
    """Rows (kind, norm, s) of the entities whose first draw is taken, with a surrogate that no entity has or gets.

    known: a written table of distinct (kind, norm). Those that have none after ``most_rounds`` draws, as where a format has
    hardly more values than there are entities, get a ``placeholder``.
    """
    n = known.count()
    own = known.select("kind", F.col("norm").alias("s"))
    taken: list[DataFrame] = []  # (kind, norm, s, ok) of each round

    def drawn(entities: DataFrame, attempt: int) -> DataFrame:
        cand = entities.select("kind", "norm", draw(F.col("kind"), F.col("norm"), key, F.lit(attempt)).alias("s"))
        used = own
        for t in taken:
            used = used.unionByName(t.filter("ok").select("kind", "s"))
        free = cand.join(used.distinct().withColumn("used", F.lit(True)), ["kind", "s"], "left")
        first = free.filter("used IS NULL").groupBy("kind", "s").agg(F.min("norm").alias("first"))
        j = free.join(first, ["kind", "s"], "left").select("kind", "norm", "s", F.col("norm").eqNullSafe(F.col("first")).alias("ok"))
        return shared.written(j, "draws", rows=n)

    for attempt in range(most_rounds):
        left = taken[-1].filter("NOT ok") if taken else known
        if not left.limit(1).count():
            break
        taken.append(drawn(left, attempt))
    out = known.select("kind", "norm", F.lit("").alias("s")).limit(0)
    for t in taken[1:]:
        out = out.unionByName(t.filter("ok").select("kind", "norm", "s"))
    if not taken:
        return out
    return out.unionByName(taken[-1].filter("NOT ok").select("kind", "norm", placeholder(F.col("kind"), F.col("norm"), key).alias("s")))


def replace(docs: DataFrame, key: str, text_col: str = "text", out: str = "surrogate") -> DataFrame:
    """``docs`` with ``text_col`` replaced and a struct ``out``: n_entities and one count per kind.

    A null text stays null; an empty one, and any without entities, as it is, however long. Repeated rows are treated alike. Other
    columns of any name come back as they are, but one named ``out``, which is replaced. An empty table gives an empty one.
    """
    cols = [c for c in docs.columns if c != out]
    # rows are packed, so that no column of theirs can clash with what is added
    d = shared.written(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), found(F.col(f"`{text_col}`")).alias("f")), "found")
    each = d.filter("f IS NOT NULL").select(F.explode("f.e").alias("x")).select("x.kind", "x.norm").filter("kind NOT IN ('initial', 'none')")
    n = d.agg(F.coalesce(F.sum(F.size("f.e")), F.lit(0))).first()[0]
    known = shared.written(each.distinct(), "entities", rows=n)
    odd = exceptions(known, key)
    if odd.limit(1).count():
        odd = shared.written(odd, "exceptions", rows=n)
        d = d.withColumn("h", F.xxhash64(F.col("r")[text_col]))
        used = d.filter("f IS NOT NULL").select("h", F.explode("f.e").alias("x")).select("h", "x.kind", "x.norm").distinct().join(odd, ["kind", "norm"])
        per = used.groupBy("h").agg(F.collect_set(F.struct("kind", "norm", "s")).alias("o"))  # of one text
        d = d.join(per, "h", "left").withColumn("o", F.coalesce("o", F.expr(f"cast(array() as {_MAP})")))
    else:
        d = d.withColumn("o", F.expr(f"cast(array() as {_MAP})"))

    def sub(x: Column) -> Column:
        other = F.get(F.filter("o", lambda o: (o["kind"] == x["kind"]) & (o["norm"] == x["norm"])), F.lit(0))["s"]
        return F.when(x["kind"] == "none", x["m"]).otherwise(_bind(F.coalesce(other, draw(x["kind"], x["norm"], key, F.lit(0))), lambda s: dressed(x["m"], x["kind"], s)))

    e = F.filter(F.coalesce(F.col("f.e"), F.expr(f"cast(array() as {_MENTIONS})")), lambda x: x["kind"] != "none")
    subs = F.concat(F.transform("f.e", sub), F.array(F.lit("")))
    joined = F.array_join(F.transform(F.arrays_zip(F.col("f.gaps").alias("g"), subs.alias("s")), lambda z: F.concat(z["g"], z["s"])), "")
    n = lambda k: F.size(F.filter(e, lambda x: x["kind"].isin(*k))).cast("long")
    counts = F.struct(F.size(e).cast("long").alias("n_entities"), *[n([k]).alias(f"n_{k}") for k in PATTERNS], n(list(NAMES)).alias("n_name"))
    text = F.when(F.col("f").isNull(), F.col("r")[text_col]).otherwise(joined)
    return d.select(*[text.alias(c) if c == text_col else F.col("r")[c].alias(c) for c in cols], counts.alias(out))


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_entities, counts per kind, and the text with surrogates; nulls, empty, long and repeated texts as in ``replace``."""
    return replace(docs.select(id_col, text_col), key, text_col).select(id_col, "surrogate.*", F.col(text_col).alias("text"))
