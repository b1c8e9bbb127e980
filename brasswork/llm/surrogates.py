"""PII surrogates (operator 7): keyed, type-consistent replacements. DataFrame functions only.

One pass finds entities by a pattern per kind; text between them is kept as it is, and each entity gets a surrogate
made from its canonical form and a secret key, so that the same entity reads alike in all documents (coreference):

* digit kinds (phone, card, ssn, ip): a keyed Feistel permutation of the digits (or of the address's 32 bits), put back
  into the entity's own format. Permutations never send two entities to one surrogate. A card keeps its distance from
  a valid check digit, a phone keeps its country code;
* email: a 16-letter local part and a keyed domain below a reserved name;
* iban, cloud keys and secret values: a keyed permutation, without fixed points, of all values of one shape: each letter
  or digit becomes one of its class, lengths and marks stay. No two values share a surrogate, however short they are;
* person, after a title: given and family name are replaced apart (so `Mr. Smith` still agrees with `Mr. John Smith`),
  made of syllables of the name's own script, with an ending of the title's gender and the case of the original.

`collisions` compares all distinct entities with their surrogates: two entities with one surrogate, or an entity that
is its own surrogate. `replace` checks that before it uses a key and moves on to the next derived key otherwise, under
which names are `LONGER` syllables longer, so that the space of names outgrows any number of them; if entities of the
documents still collide under the last key, it raises. A secret value without letters and digits stays as it is.

Defined results: null text stays null; text without entities stays as it is; repeated rows are treated alike; an empty
table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

KEY = "a key of the operator's user"
#: Derived keys that are tried before giving up.
TRIES = 5
#: Syllables that names gain with each derived key.
LONGER = 2

# Titles by gender, and syllables and gendered endings by script.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sir", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа")
NEUTRAL = ("Dr", "Prof", "доктор")
LATIN = ("ba", "be", "bo", "ca", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "si", "so", "ta", "te", "ti", "to", "va", "ve", "vi", "wa", "we", "ya", "za", "ze", "zo")
CYRILLIC = ("ба", "бе", "бо", "ва", "ве", "ви", "га", "го", "да", "де", "до", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "па", "по", "ра", "ре", "ри", "ро", "са", "се", "си", "со", "та", "те", "ти", "то")
ENDINGS = {"male": ("n", "н"), "female": ("na", "на"), "neutral": ("l", "л")}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"[\p{Lu}][\p{L}'’-]+"
_TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))

#: Kind and pattern, in the order in which they are tried at a place.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    ("secret", r"(?<=(?i:token|password|passwd|secret|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[A-Za-z0-9+/_=-]{6,}"),
    ("cloudkey", r"(?<![A-Za-z0-9])A(?:KI|SI)A[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    ("card", r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}(?:[ -]?)[0-9]{4}(?:[ -]?)[0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"),
    ("person", rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS).replace("([ -]?)", "(?:[ -]?)")
#: What every entity has; texts without it are not searched.
HINT = rf"[0-9@=:]|A(?:KI|SI)A[0-9A-Z]{{16}}|(?<![\p{{L}}])(?:{_TITLES})\.? \p{{Lu}}"


def _number(key: Column, *parts: Column, digits: int = 13) -> Column:
    """A keyed number below 16 ** digits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u001f", key, *parts).cast("binary"), 256), 1, digits), 16, 10).cast("long")


def _permuted(key: Column, x: Column, y: Column, a: Column, b: Column, tag: Column) -> tuple[Column, Column]:
    """Feistel rounds over (x, y) in 0..a-1 x 0..b-1; the size of the space is part of the key."""
    for i in range(2):
        x = F.pmod(x + _number(key, F.lit(f"x{i}"), tag, y.cast("string")), a)
        y = F.pmod(y + _number(key, F.lit(f"y{i}"), tag, x.cast("string")), b)
    return x, y


def _permuted_digits(key: Column, digits: Column, tag: str) -> Column:
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")
    x = F.substring(digits, F.lit(1), half).try_cast("long")
    y = F.substring(digits, half + 1, n).try_cast("long")
    x, y = _permuted(key, F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)), a, b, F.concat(F.lit(tag), n.cast("string")))
    return F.concat(F.when(half > 0, F.lpad(x.cast("string"), half, "0")).otherwise(F.lit("")), F.lpad(y.cast("string"), n - half, "0"))


def _refilled(shape: Column, signs: Column, own_class: str = "^[0-9]$") -> Column:
    """`shape` with its digits (or signs of another class) replaced by `signs` in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike(own_class)
        return F.struct((acc["n"] + own.cast("int")).alias("n"), F.concat(acc["out"], F.when(own, F.substring(signs, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])


#: Signs by the letter that stands for their class in a shape.
_CLASSES = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "f": "abcdef", "g": "ghijklmnopqrstuvwxyz"}


def _shape(text: Column, hexa: bool) -> Column:
    """The class of each sign. With `hexa`, hexadecimal texts are a class of their own that no other text can enter."""

    def classes(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")

    if not hexa:
        return classes(text)
    # The first letter beyond f stays beyond f, and letters before it stay before g.
    before = F.regexp_extract(text, "^([0-9a-f]*)", 1)
    low = F.concat(F.regexp_replace(F.regexp_replace(before, "[a-f]", "f"), "[0-9]", "0"), F.lit("g"), classes(F.substring(text, F.length(before) + 2, F.length(text))))
    return F.when(text.rlike("^[0-9a-f]+$"), F.repeat(F.lit("h"), F.length(text))).when(text.rlike("^[0-9a-z]+$"), low).otherwise(classes(text))


def _scrambled(key: Column, text: Column, tag: str, hexa: bool = False) -> Column:
    """A keyed permutation of the texts of one shape: signs become others of their class, and no text stays.

    Feistel rounds over the two halves, sign by sign, then one sign moved on by a step, then the rounds undone: texts
    of a shape swap places one to one, and the step in the middle leaves none where it was.
    """

    def step(acc: Column, r: Column) -> Column:
        shape, half = acc["shape"], F.floor(F.length(acc["shape"]) / 2).cast("int")
        left = F.abs(r) % 2 == 1
        other = F.when(left, F.substring(acc["text"], half + 1, F.length(shape))).otherwise(F.substring(acc["text"], F.lit(1), half))
        first = F.regexp_instr(shape, F.lit("[0aAhfg]"))

        def one(c: Column, i: Column) -> Column:
            n = _number(key, F.lit(tag), shape, F.abs(r).cast("string"), F.when(r != 0, other).otherwise(F.lit("")), i.cast("string"), digits=8)
            k = F.substring(shape, i + 1, F.lit(1))

            def moved(letters: str) -> Column:
                size = F.lit(len(letters))
                by = F.when(r == 0, 1 + F.pmod(n, size - 1)).otherwise(F.signum(r).cast("long") * F.pmod(n, size))
                return F.substring(F.lit(letters), F.pmod(F.instr(F.lit(letters), c) - 1 + by, size).cast("int") + 1, F.lit(1))

            new = c
            for name, letters in _CLASSES.items():
                new = F.when(k == name, moved(letters)).otherwise(new)
            active = F.when(r == 0, i + 1 == first).otherwise((i < half) == left)
            return F.when(active, new).otherwise(c)

        return F.struct(F.array_join(F.transform(F.split(acc["text"], ""), one), "").alias("text"), shape.alias("shape"))

    start = F.struct(text.alias("text"), _shape(text, hexa).alias("shape"))
    return F.aggregate(F.array(*[F.lit(r) for r in (1, 2, 3, 4, 0, -4, -3, -2, -1)]), start, step, lambda acc: acc["text"])


def _check_digit(digits: Column) -> Column:
    """The digit that makes `digits` + it pass the mod-10 check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0)) * 2).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))),
        F.lit(0),
        lambda a, d: a + d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0)),
    )
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def _named(key: Column, name: Column, gender: Column | None, more: int = 0) -> Column:
    """A name of the same script and case, `more` syllables longer than usual; family names without gender."""
    cyrillic = name.rlike(r"\p{IsCyrillic}")
    parts = []
    for i in range((4 if gender is None else 3) + more):
        n = _number(key, F.lit(f"name{i}" + ("" if gender is None else "g")), F.lower(name), digits=8)
        parts.append(F.when(cyrillic, F.get(F.array(*[F.lit(s) for s in CYRILLIC]), F.pmod(n, F.lit(len(CYRILLIC))).cast("int"))).otherwise(F.get(F.array(*[F.lit(s) for s in LATIN]), F.pmod(n, F.lit(len(LATIN))).cast("int"))))
    if gender is not None:
        end = F.when(gender == "male", F.lit(0)).when(gender == "female", F.lit(1)).otherwise(F.lit(2))
        parts.append(F.when(cyrillic, F.get(F.array(*[F.lit(e[1]) for e in ENDINGS.values()]), end)).otherwise(F.get(F.array(*[F.lit(e[0]) for e in ENDINGS.values()]), end)))
    made = F.concat(*parts)
    return F.when(F.upper(name) == name, F.upper(made)).otherwise(F.initcap(made))


def kind_of(entity: Column) -> Column:
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS):
        if kind != "secret":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What two mentions of one entity share."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", "")).when(kind.isin("email", "person"), F.lower(F.regexp_replace(entity, "[ ]+", " "))).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity)


def surrogate(entity: Column, key: Column, more: int = 0) -> Column:
    """The replacement of one entity; names are `more` syllables longer than usual."""
    kind = kind_of(entity)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    country = F.length(F.regexp_extract(entity, r"^\+([0-9]{1,3})[ .(-]", 1))
    phone = F.concat(F.substring(digits, F.lit(1), country), _permuted_digits(key, F.substring(digits, country + 1, F.length(digits)), "phone"))
    body = _permuted_digits(key, F.substring(digits, F.lit(1), F.length(digits) - 1), "card")
    off = F.coalesce(F.substring(digits, F.length(digits), F.lit(1)).try_cast("int"), F.lit(0)) - _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))
    card = F.concat(body, F.pmod(_check_digit(body) + off, F.lit(10)).cast("string"))
    plain = F.regexp_replace(entity, " ", "")
    octets = F.transform(F.split(entity, r"\."), lambda o: F.coalesce(o.try_cast("long"), F.lit(0)))
    x, y = _permuted(key, F.coalesce(F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1)), F.lit(0)), F.coalesce(F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3)), F.lit(0)), F.lit(65536), F.lit(65536), F.lit("ip"))
    ip = F.concat_ws(".", F.floor(x / 256).cast("int"), F.pmod(x, F.lit(256)).cast("int"), F.floor(y / 256).cast("int"), F.pmod(y, F.lit(256)).cast("int"))
    low = F.lower(entity)
    local = F.translate(F.substring(F.sha2(F.concat_ws("\u001f", key, F.lit("email"), low).cast("binary"), 256), 1, 16), "0123456789", "ghijklmnop")
    email = F.concat(local, F.lit("@mail"), _number(key, F.lit("domain"), F.regexp_extract(low, "@(.*)$", 1), digits=6).cast("string"), F.lit(".example.org"))
    title = F.regexp_extract(entity, rf"^({_TITLES})(?=[. ])", 1)
    gender = F.when(title.isin(*MALE), F.lit("male")).when(title.isin(*FEMALE), F.lit("female")).otherwise(F.lit("neutral"))
    names = F.regexp_extract(entity, rf"^(?:{_TITLES})\.? (.*)$", 1)
    given, family = F.regexp_extract(names, "^([^ ]+) [^ ]+$", 1), F.regexp_extract(names, "([^ ]+)$", 1)
    person = F.concat(F.regexp_extract(entity, rf"^((?:{_TITLES})\.? )", 1), F.when(given != "", F.concat(_named(key, given, gender, more), F.lit(" "))).otherwise(F.lit("")), _named(key, family, None, more))
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", _refilled(entity, phone))
        .when(kind == "card", _refilled(entity, card))
        .when(kind == "ssn", _refilled(entity, _permuted_digits(key, digits, "ssn")))
        .when(kind == "ip", ip)
        .when(kind == "person", person)
        .when(kind == "cloudkey", F.concat(F.substring(entity, 1, 4), _scrambled(key, F.substring(entity, F.lit(5), F.lit(16)), "cloud")))
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), _refilled(F.substring(entity, F.lit(3), F.length(entity)), _scrambled(key, F.substring(plain, F.lit(3), F.length(entity)), "iban"), "[^ ]")))
        .otherwise(_scrambled(key, entity, "secret", hexa=True))
    )


def entities(docs: DataFrame) -> DataFrame:
    """kind, canonical form and one spelling of every distinct entity of all texts."""
    found = docs.where(F.col("text").rlike(HINT)).select(F.explode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("entity"))
    spelled = found.groupBy("entity").agg(F.count("*").alias("n"))
    kind = kind_of(F.col("entity"))
    return spelled.select("entity", kind.alias("kind"), "n").withColumn("canonical", canonical(F.col("kind"), F.col("entity")))


def collisions(found: DataFrame, key: str, more: int = 0) -> DataFrame:
    """Surrogates that more than one entity of a kind would get, or that leave an entity as it is."""
    made = found.withColumn("new", surrogate(F.col("entity"), F.lit(key), more))
    made = made.withColumn("new", canonical(F.col("kind"), F.col("new")))
    by = made.groupBy("kind", "new").agg(F.min("canonical").alias("least"), F.max("canonical").alias("most"))
    return by.where((F.col("least") != F.col("most")) | ((F.col("kind") != "person") & (F.col("new") == F.col("least")) & F.col("new").rlike("[A-Za-z0-9]")))


def fitting_key(docs: DataFrame, key: str = KEY) -> tuple[str, int]:
    """The first key derived from `key`, and the syllables added to names, that keep all entities of the documents apart."""
    found = entities(docs.select("text"))
    found = _shared.written(found.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "entities")
    for i in range(TRIES):
        own = key if i == 0 else f"{key}\u001e{i}"
        if not collisions(found, own, LONGER * i).limit(1).count():
            return own, LONGER * i
    raise RuntimeError(f"entities still share surrogates under {TRIES} keys; give another key")


def replaced(text: Column, key: Column, more: int = 0) -> Column:
    """`text` with every entity replaced: the parts between entities, and the entities' surrogates, in turn."""
    between = F.split(text, ANY, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda e: surrogate(e, key, more))
    whole = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(HINT), whole).otherwise(text)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Documents with surrogates in `text`; all other columns as they are."""
    own, more = fitting_key(docs, key)
    return docs.withColumn("text", replaced(F.col("text").cast("string"), F.lit(own), more))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    out = replace(docs.select("doc_id", "text").withColumn("before", F.col("text")))
    n = F.when(F.col("before").rlike(HINT), F.size(F.regexp_extract_all("before", F.lit(ANY), F.lit(0)))).otherwise(F.lit(0))
    return out.select("doc_id", "text", F.coalesce(n, F.lit(0)).cast("long").alias("n_entities"))
