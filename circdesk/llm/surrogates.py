"""Personal data replaced by surrogates, with DataFrame functions only.

Every detected entity gets a keyed replacement of its own type: letters stand for letters and
digits for digits in the mention's layout, addresses stay addresses, card numbers keep a valid check
digit, names keep their gender and script. All mentions of an entity, however they are written, get
the same surrogate, and different entities get different ones; a table of all entities is checked
for that, and those that collide with one another or with a real entity draw again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circdesk.llm.support import durable

# Titles by gender, given names and name endings by script and gender.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Госпожа", "Κυρία")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Доктор")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "f"): ("Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia", "Vera"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
    ("greek", "m"): ("Αλέξανδρος", "Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος", "Στέφανος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "do", "fe", "gar", "hol", "ken", "lam", "mer", "nor", "pel", "ros", "sen", "tor", "vin", "wes", "zan"),
    "cyrillic": ("бе", "ва", "гор", "дан", "зем", "кар", "лев", "мир", "нов", "пет", "рам", "сол", "тал", "фед", "хор", "щег"),
    "greek": ("βα", "γε", "δη", "θε", "κα", "λα", "μα", "νι", "πα", "ρο", "στα", "τσι", "φω", "χα", "ξε", "ζα"),
}
ENDINGS = {
    ("latin", "m"): "er", ("latin", "f"): "er", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова",
    ("greek", "m"): "ης", ("greek", "f"): "η",
}

_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xoxb)[-_][A-Za-z0-9]{16,100})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{Ll}}'-]+(?: \p{{Lu}}[\p{{Ll}}'-]+)?",
}
ANY = "(" + "|".join(PATTERNS.values()) + ")"
# Every pattern holds one of these, so that a text without them holds no entity.
_MAYBE = rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|AKIA|(?:sk|ghp|xoxb)[-_]|(?:{_TITLES})\.? \p{{Lu}}"
_VAIN = 8  # rounds without a single free surrogate after which there is none


def replace_entities(docs: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_replaced, kinds, and ``carry``.

    Types: email, secret, iban, ip, national_id, card, phone and titled names. The same ``key`` gives the same
    surrogates on the same corpus. Null texts stay null with 0 replaced; empty texts, texts without
    entities, repeated rows and null doc_ids are kept as they are. An empty table gives an empty
    result. Only doc_id, text and the columns in ``carry`` are read.

    Texts that cannot hold an entity are never shuffled. The others meet their replacements by a
    hash of the whole text: equal texts have equal replacements, so these are gathered once per text.
    """
    extra = [c for c in carry if c not in ("doc_id", "text", "n_replaced", "kinds")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(c) for c in extra] or [F.lit(0)]).alias("carried"),
    )
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    mark = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")]
    # An aggregate by text drops repeats before the shuffle, so a text that a third of the rows share is handled once.
    mentions = durable(
        rows.where(maybe).select(*mark, F.regexp_extract_all("text", F.lit(ANY)).alias("found"))
        .where(F.size("found") > 0).groupBy("t1", "t2").agg(F.first("found").alias("found"))
        .select("t1", "t2", F.posexplode("found").alias("place", "mention"))
        .withColumn("kind", _kind(F.col("mention")))
        .withColumn("entity", _entity(F.col("kind"), F.col("mention")))
    )
    table = entity_surrogates(mentions.select("kind", "entity").distinct(), key)
    shown = mentions.join(table, ["kind", "entity"]).withColumn("shown", _in_layout())
    replaced = durable(
        shown.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("place", "shown", "kind"))).alias("parts"))
    )
    touched = rows.where(maybe).select("*", *mark).join(replaced, ["t1", "t2"], "left").select(
        "doc_id", _filled().alias("text"),
        F.coalesce(F.size("parts"), F.lit(0)).alias("n_replaced"),
        F.coalesce(F.array_sort(F.array_distinct("parts.kind")), F.array().cast("array<string>")).alias("kinds"),
        "carried",
    )
    others = rows.where(~maybe).select(
        "doc_id", "text", F.lit(0).alias("n_replaced"), F.array().cast("array<string>").alias("kinds"), "carried"
    )
    return touched.unionByName(others).select(
        "doc_id", "text", "n_replaced", "kinds", *[F.col("carried").getField(c).alias(c) for c in extra]
    )


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity and a surrogate that no other entity of the kind has and that is no real entity.

    Of colliding entities the first keeps its surrogate and the others draw again, in rounds over
    those that are still open only.
    """
    open_ = durable(entities)
    real = open_
    done = open_.limit(0).withColumn("surrogate", F.lit(""))
    vain, left, attempt = 0, None, 0
    while vain < _VAIN:
        drawn = open_.withColumn("surrogate", _draw(F.col("kind"), F.col("entity"), key, attempt))
        first = Window.partitionBy("kind", "surrogate").orderBy("entity")  # only entities that collide meet here
        drawn = drawn.withColumn("turn", F.row_number().over(first))
        taken = done.select("kind", "surrogate").unionByName(real.select("kind", F.col("entity").alias("surrogate")))
        drawn = drawn.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        fine = (F.col("turn") == 1) & F.col("taken").isNull()
        drawn, seen = durable(drawn.withColumn("fine", fine), bad=F.count_if(~fine))
        done = done.unionByName(drawn.where("fine").select("kind", "entity", "surrogate"))
        if not seen["bad"]:
            return done
        vain = vain + 1 if seen["bad"] == left else 0
        left, attempt = seen["bad"], attempt + 1
        open_ = drawn.where("not fine").select("kind", "entity")
    raise ValueError(f"no free surrogates left for {left} entities")


def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([*PATTERNS.items()][:-1]):
        out = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


def _entity(kind: Column, mention: Column) -> Column:
    """The mention without what may differ between mentions of one entity."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    name = F.regexp_replace(mention, rf"\A(?:{_TITLES})\.? ", "")
    gender = F.when(mention.rlike(rf"\A(?:{'|'.join(MALE_TITLES)})\b"), "m").when(
        mention.rlike(rf"\A(?:{'|'.join(FEMALE_TITLES)})\b"), "f").otherwise("n")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind.isin("ip", "secret"), mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "name", F.concat_ws("/", gender, name))
        .otherwise(digits)
    )


def _draw(kind: Column, entity: Column, key: str, attempt: int) -> Column:
    """A keyed surrogate in the form of ``entity``."""
    seed = F.concat_ws("\n", F.lit(key), kind, entity, F.lit(attempt))
    bytes_ = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\n+")), 512))

    def number(i: Column, below: int) -> Column:
        return F.pmod(F.conv(F.substr(bytes_, F.pmod(i, F.lit(62)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(below))

    def letter(alphabet: str, i: Column) -> Column:
        return F.substr(F.lit(alphabet), number(i, len(alphabet)) + 1, F.lit(1))

    def like(text: Column, hexadecimal: bool = False, skip: int = 0, stream: int = 0) -> Column:
        def one(c: Column, i: Column) -> Column:
            i = i + stream
            low, up = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            new = (F.when(c.rlike("[0-9]"), letter("0123456789", i)).when(c.rlike("[a-z]"), letter(low, i))
                   .when(c.rlike("[A-Z]"), letter(up, i)).otherwise(c))
            return F.when(i - stream < skip, c).otherwise(new) if skip else new
        return F.array_join(F.transform(F.split(text, ""), one), "")

    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.concat(like(local), F.lit("@"), like(F.regexp_replace(domain, r"\.[a-z]+\z", ""), stream=31), F.lit(".example"))
    ip = F.concat_ws(".", *[(number(F.lit(i), 222 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string") for i in range(4)])
    is_hex = entity.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")
    secret = F.when(is_hex, like(entity, hexadecimal=True)).when(entity.startswith("AKIA"), like(entity, skip=4)).otherwise(
        F.concat(F.regexp_extract(entity, r"\A(\w+?[-_])", 1), like(F.regexp_replace(entity, r"\A\w+?[-_]", ""))))
    body = like(F.substr(entity, F.lit(1), F.length(entity) - 1))
    card = F.when(_check_digit(entity) == F.substr(entity, F.length(entity)).cast("int"),
                  F.concat(body, _check_digit(F.concat(body, F.lit("0"))).cast("string"))).otherwise(like(entity))
    # Numbers keep their first digit, which says what kind of number it is.
    number_ = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(like(entity), F.lit(2)))
    card = F.when(kind == "card", card)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", secret)
        .when(kind == "iban", like(entity, skip=2)).when(kind == "name", _name(entity, number, attempt))
        .when(kind == "card", card).when(kind == "phone", number_).otherwise(like(entity))
    )


def _check_digit(digits: Column) -> Column:
    """The last digit that makes a number of this length valid (mod 10), whatever its last digit is now."""
    reverse = F.split(F.reverse(F.substr(digits, F.lit(1), F.length(digits) - 1)), "")
    terms = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2).cast("int")).otherwise(c.cast("int")))
    total = F.aggregate(F.transform(terms, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _name(entity: Column, number, attempt: int) -> Column:
    """Given names of the same gender and script where there is one, and a family name of the script.

    Family names grow by a syllable every second draw, so there are always enough of them.
    """
    gender, name = F.substring_index(entity, "/", 1), F.substring_index(entity, "/", -1)
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # A title that says nothing leaves it to the name.
    for (s, g), names in GIVEN.items():
        gender = F.when((gender == "n") & F.substring_index(name, " ", 1).isin(*names), g).otherwise(gender)
    gender = F.when(gender == "n", F.when(number(F.lit(0), 2) == 0, "m").otherwise("f")).otherwise(gender)
    out = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        def pick(words: Sequence[str], i: int) -> Column:
            return F.element_at(F.array(*[F.lit(w) for w in words]), number(F.lit(i), len(words)) + 1)
        family = F.concat(F.initcap(pick(SYLLABLES[s], 2)), *[pick(SYLLABLES[s], i) for i in range(3, 6 + attempt // 2)], F.lit(ENDINGS[s, g]))
        whole = F.when(name.contains(" "), F.concat_ws(" ", pick(names, 1), family)).otherwise(family)
        out = F.when((script == s) & (gender == g), whole).otherwise(out)
    return out


def _in_layout() -> Column:
    """The surrogate with the mention's title, case, spaces and punctuation."""
    mention, kind, new = F.col("mention"), F.col("kind"), F.col("surrogate")
    spread = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(
        c.rlike("[0-9A-Z]"),
        F.substr(new, F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1)),
    ).otherwise(c)), "")
    title = F.regexp_extract(mention, rf"\A((?:{_TITLES})\.? )", 1)
    return (
        F.when(kind.isin("iban", "card", "phone", "national_id"), spread)
        .when(kind == "name", F.concat(title, new))
        .when((kind == "email") & (F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(new))
        .otherwise(new)
    )


def _filled() -> Column:
    """The text between the mentions and the surrogates in turn."""
    between = F.split("text", ANY, -1)
    both = F.zip_with(between, F.col("parts.shown"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.col("parts").isNull(), F.col("text")).otherwise(F.array_join(both, ""))
