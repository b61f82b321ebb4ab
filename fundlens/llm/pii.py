"""Surrogates for personal data, with DataFrame expressions only.

Entities are found by one pattern of typed alternatives. What a mention stands for is its key: the
digits of a phone or card number, with the plus of an international one; each given name with the
gender of its form of address, and the family name, in small letters; else the value itself. Every
distinct key gets a surrogate made from a keyed hash of (type, key, attempt), and the mention is
written with it in its own format: digits go where it had digits, names in its capitals after its
form of address. So equal keys get equal surrogates in every document (coreference), whatever the
format. Letters become letters of the same case and script; addresses move to the private 10.0.0.0/8,
mail to example domains, card numbers keep a right check digit if they had one, phone numbers their
country code. A given name comes from a list by gender and script, a family name is built from the
syllables of the script; particles in small letters (van, de) stay.

A number that looks like a card but fails its check digit is no card and stays as it is.

Collision checks: a surrogate that another key has too, or that is itself a key of the corpus,
goes to the next attempt, until none is left; so distinct keys stay distinct. Each round touches
only the keys that still collide. Later attempts draw from larger spaces: longer names, more mail
hosts, and for addresses the reserved 240.0.0.0/4 as well. Phone and card numbers keep their length;
keys that have no free value after ``MAX_ATTEMPTS`` raise an error.

Cases: a null text stays null, an empty one empty; texts without entities are passed on as they
are. Repeated rows give repeated, equal rows. An empty table gives no rows. Other columns stay,
whatever their names. Every repeated group of the pattern is bounded or possessive, so very long
runs of any characters neither recurse nor backtrack over each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.session import materialise

# Forms of address by gender, and given names by script and gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robin", "Simon", "Victor"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Rosa", "Vera"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Иван", "Лев", "Павел", "Роман"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Елена", "Ирина", "Лидия", "Мария", "Ольга"),
}
SYLLABLES = {
    "latin": ("ba", "del", "fen", "gor", "hal", "kem", "lin", "mor", "nas", "pel", "ras", "sel", "tam", "vor", "wen", "zim"),
    "cyrillic": ("бар", "вел", "гор", "дан", "жел", "зор", "кал", "лен", "мир", "нов", "пол", "рем", "сав", "тур", "хол", "чер"),
}
MAX_ATTEMPTS = 40
_JUNK = r"[^\w\n]{1,5}"
_GAP = r"[ ./() ‐-–-]"
_TITLES = "|".join([t for x in MALE + FEMALE for t in (x, x.upper())])
_PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "zu", "bin", "al", "el")
_PARTICLE = "(?:" + "|".join(_PARTICLES) + ") "
# Initials, or words of any letters, hyphens and apostrophes behind a capital.
_PART = rf"(?:\p{{Lu}}\.(?= ?\p{{Lu}}| {_PARTICLE})|\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’-][\p{{L}}\p{{M}}]++)*+)"
PATTERNS = {
    # A name in the domain system has at most 126 labels below its last one, of 63 characters at most.
    "email": r"(?<![\w.+-])[\w.+-]++@(?:[\w-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    # International in groups of 3-3-4 with junk between them, or in any groups; with the area in
    # brackets; 3-3-4; pairs behind 0x; area code with 0.
    "phone": (
        rf"\+\d{{1,3}}{_JUNK}\d{{3}}{_JUNK}\d{{3}}{_JUNK}\d{{4}}(?!\d)"
        rf"|\+\d(?:{_GAP}{{0,3}}\d){{7,14}}(?!\d)"
        rf"|(?<![\w+])\(\d{{2,5}}\){_GAP}{{0,2}}\d{{3,4}}{_GAP}?\d{{3,6}}(?!\d)"
        r"|(?<![\w.+-])\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d)"
        r"|(?<![\w.+-])0\d(?:[ .-]?\d{2}){4}(?!\d)"
        r"|(?<![\w.+-])(?=0\d{2}(?:[ /-]?\d){5,12}(?!\d))0\d{2,4}(?:[ /-]\d{2,8}){1,4}(?!\d)"
    ),
    "card": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d])(?!\.\d)",
    # Hexadecimal digits; keys with a known prefix; web tokens; 32 or more characters of all three sorts.
    "secret": (
        r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
        r"|(?<![\w-])(?:[spr]k[-_][\w-]{16,}|gh[opsur]_\w{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[\w-]{35})(?![\w-])"
        r"|(?<![\w.-])eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}"
        r"|(?<![\w-])(?=[\w-]{32})(?=[^\d\s]{0,99}\d)(?=[^A-Z\s]{0,99}[A-Z])(?=[^a-z\s]{0,99}[a-z])[0-9A-Za-z_-]{32,}(?![\w-])"
    ),
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:{_PARTICLE}){{0,2}}{_PART}(?: (?:{_PARTICLE}){{0,2}}{_PART}){{0,5}}+",
}
# Secrets come before cards: a long row of digits in hexadecimal is no card.
ORDER = ("email", "secret", "ip", "phone", "card", "name")
# The first character tells which kinds can begin at it, so most places are left at once.
PATTERN = "|".join((
    r"(?=[\d+(])(?:" + "|".join(PATTERNS[k] for k in ORDER[:-1]) + ")",
    rf"(?<![A-Za-z])(?=[A-Za-z_.-])(?:{PATTERNS['email']}|{PATTERNS['secret']})",
    rf"(?=\p{{Lu}}){PATTERNS['name']}",
))


def found_entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def entity_type(value: Column) -> Column:
    out = None
    for kind in ORDER:
        hit = value.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when((out.otherwise("name") == "card") & (check_sum(digits) % 10 != 0), "number").otherwise(out.otherwise("name"))


def check_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, whose last digit counts once."""
    digit = lambda i: digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    steps = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(steps, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))


# The country code of an international number, or the 0 of an area code.
_LEAD = "^([+](1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|0)"


def entity_keys(kind: Column, value: Column) -> Column:
    """Array of (kind, value) that a mention stands for: one, or one for each part of a name."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    gender = F.when(F.lower(value).rlike("^(" + "|".join(x.lower() for x in FEMALE) + ")[. ]"), "given_f").otherwise("given_m")
    parts = F.filter(_name_parts(value), lambda x: ~x.isin(*_PARTICLES))
    last = F.size(parts) - 1
    names = F.transform(parts, lambda x, i: F.struct(F.when(i == last, "family").otherwise(gender).alias("kind"), F.lower(x).alias("value")))
    one = lambda v: F.array(F.struct(kind.alias("kind"), v.alias("value")))
    number = F.when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits)).otherwise(digits)
    return F.when(kind == "name", names).when(kind.isin("phone", "card"), one(number)).otherwise(one(value))


def _name_parts(value: Column) -> Column:
    """Words behind the form of address."""
    words = F.split(value, " ")
    return F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))


def written(kind: Column, value: Column, new: Column) -> Column:
    """The mention with the surrogates ``new`` of its keys, in its own format."""
    first = F.get(new, F.lit(0))
    digits = F.regexp_replace(first, "[^0-9]", "")
    at = lambda i: F.length(F.regexp_replace(value.substr(F.lit(1), i), "[^0-9]", ""))
    char = lambda i: value.substr(i, F.lit(1))
    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(char(i).rlike("[0-9]"), digits.substr(at(i), F.lit(1))).otherwise(char(i))), "")
    parts = F.filter(_name_parts(value), lambda x: ~x.isin(*_PARTICLES))
    initial = lambda x: F.array_join(F.transform(F.split(x, "-"), lambda y: F.initcap(y)), "-")
    cased = F.transform(F.arrays_zip(parts.alias("old"), new.alias("new")), lambda x: F.when((F.length(x.old) > 2) & (x.old == F.upper(x.old)), F.upper(x.new)).otherwise(initial(x.new)))
    # Particles stay, in front of the family name.
    kept = F.filter(_name_parts(value), lambda x: x.isin(*_PARTICLES))
    head = F.concat(F.array(F.substring_index(value, " ", 1)), F.slice(cased, 1, F.greatest(F.size(cased) - 1, F.lit(0))), kept, F.slice(cased, F.greatest(F.size(cased), F.lit(1)), F.lit(1)))
    return F.when(kind == "name", F.array_join(head, " ")).when(kind.isin("phone", "card"), number).otherwise(first)


def _digest(key: str, value: Column, attempt: Column) -> Column:
    """Hexadecimal digits of the keyed hash; as many as the longest value may use up."""
    part = [F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), attempt.cast("string"), value), 256) for i in range(4)]
    return F.concat(*part)


def _reshaped(value: str, digest: str) -> str:
    """SQL: digits and letters replaced in place; the hash is used again after 128 characters."""
    byte = f"cast(conv(substr({digest}, 1 + (2 * i) % 256, 2), 16, 10) as int)"
    c = "c"
    return (  # split into characters: substr would count from the start for each
        f"array_join(transform(split({value}, ''), (c, i) -> CASE "
        f"WHEN {c} RLIKE '[0-9]' THEN cast({byte} % 10 as string) "
        f"WHEN {c} RLIKE '[a-z]' THEN char(97 + {byte} % 26) "
        f"WHEN {c} RLIKE '[A-Z]' THEN char(65 + {byte} % 26) "
        f"WHEN {c} RLIKE '[а-я]' THEN substr('абвгдежзиклмнопрстуф', 1 + {byte} % 20, 1) "
        f"WHEN {c} RLIKE '[А-Я]' THEN substr('АБВГДЕЖЗИКЛМНОПРСТУФ', 1 + {byte} % 20, 1) "
        f"WHEN {c} RLIKE '\\\\p{{Ll}}' THEN char(97 + {byte} % 26) "
        f"WHEN {c} RLIKE '\\\\p{{Lu}}' THEN char(65 + {byte} % 26) "
        f"ELSE {c} END), '')"
    )


def _check_sum(digits: str) -> str:
    """SQL: Luhn sum of a string of digits, whose last digit counts once."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    twice = f"(2 * {d} - CASE WHEN 2 * {d} > 9 THEN 9 ELSE 0 END)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {twice} ELSE {d} END)"


def with_surrogates(values: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to rows (kind, value, attempt)."""
    df = values.withColumn("__d", _digest(key, F.col("value"), F.col("attempt")))
    df = df.withColumn("__r", F.expr(_reshaped("value", "__d")))
    byte = lambda i: f"cast(conv(substr(__d, {1 + 2 * i}, 2), 16, 10) as int)"
    capital = lambda c: f"CASE WHEN value = upper(value) THEN upper({c}) ELSE {c} END"
    host = "conv(substr(__d, 205, 2 + 2 * least(attempt, 5)), 16, 10)"
    email = capital(f"concat(substring_index(__r, '@', 1), '@mail', {host}, '.example.', CASE WHEN {byte(101)} % 2 = 0 THEN 'org' ELSE 'net' END)")
    ip = f"concat_ws('.', CASE WHEN attempt < 2 THEN 10 ELSE 240 + {byte(3)} % 15 END, {byte(0)}, {byte(1)}, {byte(2)})"
    # A card that passes the check keeps passing: its last digit is set anew.
    df = df.withColumn("__o", F.regexp_replace("value", "[^0-9]", "")).withColumn("__n", F.regexp_replace("__r", "[^0-9]", ""))
    head = "concat(substr(__n, 1, length(__n) - 1), '0')"
    df = df.withColumn("__z", F.expr(head))
    card = (
        f"CASE WHEN kind = 'card' AND {_check_sum('__o')} % 10 = 0 THEN "
        f"concat(substr(__r, 1, length(__r) - 1), cast((10 - {_check_sum('__z')} % 10) % 10 as string)) ELSE __r END"
    )
    # The country code stays, or the 0 of an area code.
    lead = f"regexp_extract(value, '{_LEAD}', 0)"
    phone = f"concat({lead}, substr(__r, length({lead}) + 1))"
    script = "CASE WHEN value RLIKE '\\\\p{IsCyrillic}' THEN 'cyrillic' ELSE 'latin' END"
    def pick(options: tuple[str, ...], at: int) -> str:
        return "element_at(array(" + ", ".join(f"'{x}'" for x in options) + f"), 1 + {byte(at)} % {len(options)})"

    more = lambda x: f"array_join(transform(sequence(0, attempt), i -> CASE WHEN i = 0 THEN '' ELSE {x} END), '')"
    # One more name or syllable for each attempt; the byte differs from step to step.
    step = lambda x: f"element_at(array({', '.join(repr(o) for o in x)}), 1 + cast(conv(substr(__d, 20 + (2 * i) % 200, 2), 16, 10) as int) % {len(x)})"
    given = "lower(CASE " + " ".join(f"WHEN {script} = '{s}' AND kind = 'given_{g}' THEN concat({pick(names, 0)}, {more(f"concat('-', {step(names)})")})" for (s, g), names in GIVEN.items()) + " END)"
    syllables = {s: f"concat({', '.join(pick(x, i) for i in range(1, 5))}, {more(step(x))})" for s, x in SYLLABLES.items()}
    family = f"CASE WHEN {script} = 'cyrillic' THEN {syllables['cyrillic']} ELSE {syllables['latin']} END"
    surrogate = (
        f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} "
        f"WHEN 'phone' THEN {phone} WHEN 'given_m' THEN {given} WHEN 'given_f' THEN {given} WHEN 'family' THEN {family} ELSE __r END"
    )
    return df.withColumn("surrogate", F.expr(surrogate)).drop("__d", "__r", "__o", "__n", "__z")


def assign_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): one to one, and no surrogate is a value.

    A value that keeps its surrogate keeps it in later rounds: of those that share one, the lowest
    attempt and then the smallest value stays.
    """
    known = materialise(with_surrogates(values.withColumn("attempt", F.lit(0)), key), "surrogates")
    taken = values.select(F.col("value").alias("surrogate"), F.lit(True).alias("taken")).distinct()
    this = F.struct("attempt", "value", "kind")
    for _ in range(MAX_ATTEMPTS):
        # A minimum, not a rank in a window: many values may share a surrogate in the first rounds.
        first = known.groupBy("surrogate").agg(F.min(this).alias("first"))
        judged = known.join(first, "surrogate").join(taken, "surrogate", "left").withColumn("again", (F.col("first") != this) | F.col("taken").isNotNull())
        judged = materialise(judged.select("kind", "value", "attempt", "surrogate", "again"), "judged")
        if judged.where("again").isEmpty():
            return known
        next_try = with_surrogates(judged.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), key)
        known = materialise(judged.where("NOT again").drop("again").unionByName(next_try), "surrogates")
    kinds = [r.kind for r in judged.where("again").select("kind").distinct().collect()]
    raise ValueError(f"no free surrogates left for some values of {', '.join(sorted(kinds))}")


def replace_entities(docs: DataFrame, key: str, report: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced under the secret ``key``.

    ``report`` adds their number under that name, which must not be a column of ``docs``.
    """
    columns = list(docs.columns)
    if report in columns:
        raise ValueError(f"docs has a column {report}")
    # The pattern looks at each text once; only what it found is worked on.
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    found = F.coalesce(found_entities(F.col("text").cast("string")), F.array().cast("array<string>"))
    tagged = materialise(docs.select(row, found.alias("found")), "tagged")
    text = F.col("row.text").cast("string")
    # Equal texts have equal results: each is worked on once, under a 128-bit hash.
    hit = tagged.where("size(found) > 0").select("row", "found", F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))
    texts = materialise(hit.groupBy("k1", "k2").agg(F.any_value("found").alias("found")), "entities")
    each = texts.select("k1", "k2", F.posexplode("found").alias("pos", "value"))
    kind, value = F.col("kind"), F.col("value")
    values = materialise(each.select("value").distinct().select(entity_type(value).alias("kind"), "value"), "values")
    keys = materialise(values.where("kind <> 'number'").select("kind", "value", F.posexplode(entity_keys(kind, value)).alias("at", "k")), "keys")
    surrogates = assign_surrogates(keys.select("k.kind", "k.value").distinct(), key).select(F.col("kind").alias("k_kind"), F.col("value").alias("k_value"), "surrogate")
    mentions = keys.withColumns({"k_kind": F.col("k.kind"), "k_value": F.col("k.value")}).join(surrogates, ["k_kind", "k_value"]).groupBy("kind", "value").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))), lambda x: x.surrogate).alias("new")
    )
    known = mentions.select("value", written(kind, value, F.col("new")).alias("surrogate"), F.lit(1).alias("real")).unionByName(
        values.where("kind = 'number'").select("value", value.alias("surrogate"), F.lit(0).alias("real"))
    )
    lists = each.join(known, "value").groupBy("k1", "k2").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "surrogate"))), lambda x: x.surrogate).alias("new"), F.sum("real").alias("n")
    )
    joined = hit.join(lists, ["k1", "k2"]).select("row", "new", "n", F.split(text, PATTERN, -1).alias("pieces"))
    filled = F.array_join(F.expr("transform(pieces, (p, i) -> concat(p, coalesce(get(new, i), '')))"), "")
    kept = lambda c: F.col(f"row.`{c}`").alias(c)
    counted = lambda n: [n.cast("long").alias(report)] if report else []
    done = joined.select(*[filled.alias("text") if c == "text" else kept(c) for c in columns], *counted(F.col("n")))
    rest = tagged.where("size(found) = 0").select(*map(kept, columns), *counted(F.lit(0)))
    return rest.unionByName(done)
