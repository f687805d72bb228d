"""Personal data replaced by surrogates of the same kind, script, gender and format.

Patterns find e-mail and IP addresses, phone, card and account numbers, secrets after their key
words, and names after forms of address.  Each distinct entity, in its canonical form (digits of a
number, lower case of an address), gets a surrogate that a keyed hash decides: digits for digits,
letters for letters of the same script and case, octets for octets, names from lists by gender and
script.  Canonical forms are the same entity wherever they are and however they are written, so they
share a surrogate, put into the format of each place.

First and last names are entities of their own, last names without regard to gender, so a person is
the same with and without first name.  Initials and particles between or before them stay.  In a document that names a person after a form of address, or
has a secret after its key word, further mentions of these names and values, as whole words, are
replaced too.

Surrogates are checked: two entities of a kind never share one, and none is an entity of the corpus.
Those that fail are drawn again.  Documents without entities pass straight through; of the others
only the entities are joined.

Defined results: a NULL text stays NULL; rows with NULL ids and repeated rows are rows as any other;
columns of any other name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import bound, packed, settle

MAX_ROUNDS = 60

# Patterns of entities in order of precedence.  What a group named `keep` holds stays.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLE_M = "(?:Mr|Herr|Monsieur|M|Sr|Señor|г-н|господин)"
_TITLE_F = "(?:Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|г-жа|госпожа)"
_PARTICLES = "(?:(?:de|la|le|du|des|von|van|der|den|di|da|del|dos|zu) ){0,3}"
_WORD = "\\p{Lu}(?:['’]\\p{Lu})?\\p{Ll}+(?:['’-]?\\p{Lu}\\p{Ll}+)*"
_NAME = f"{_PARTICLES}{_WORD}(?: (?:\\p{{Lu}}\\. ){{0,2}}{_PARTICLES}{_WORD})?"
PATTERNS = {
    "email": "[\\p{L}0-9._%+-]+@[\\p{L}0-9-]+(?:\\.[\\p{L}0-9-]+)+",
    "secret": "(?i:\\b(?:password|passwd|pwd|passwort|contraseña|secret|token|api[_-]?key|access[_-]?key)"
    "\\s{0,3}[=:]\\s{0,3}[\"']?)[^\\s\"']{6,}",
    "key": "\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b|\\bgh[opusr]_[A-Za-z0-9]{20,}\\b|\\bsk-[A-Za-z0-9]{20,}\\b",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "iban": "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\\b",
    "card": "(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?<![0-9])(?:\\+[0-9]{1,3}[ .-]?)?\\(?[0-9]{2,4}\\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    "|\\+[0-9]{8,14}(?![0-9])",
    "male": f"\\b{_TITLE_M}\\.? {_NAME}",
    "female": f"\\b{_TITLE_F}\\.? {_NAME}",
}
# What stays of an entity in front of its surrogate: key words, the country of a number, titles.
KEPT = {
    "secret": "^(?i:[^=:]*[=:]\\s{0,3}[\"']?)",
    "key": "^(?:AKIA|ASIA|gh[opusr]_|sk-)",
    "iban": "^[A-Z]{2}",
    "phone": "^\\+[0-9]{1,2}(?=[ .(-])",
    "male": f"^{_TITLE_M}\\.? {_PARTICLES}",
    "female": f"^{_TITLE_F}\\.? {_PARTICLES}",
}
# A text without any of these has no entity.
HINT = "[@0-9]|[=:]|\\b(?:M|Mr|Mrs|Ms|Miss|Mme|Herr|Frau|Monsieur|Madame|Sra?|Señora?|г-н|г-жа|госп)"
# First names by gender and script, and syllables of last names by script.
FIRST = {
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Noah "
    "Oscar Paul Ralf Simon Tom Victor",
    ("female", "latin"): "Ada Berta Clara Diana Emma Flora Greta Hanna Ida Julia Klara Lena Maria "
    "Nora Olga Paula Rosa Sara Tina Vera",
    ("male", "cyrillic"): "Иван Пётр Олег Антон Борис Виктор Глеб Денис Егор Илья",
    ("female", "cyrillic"): "Анна Мария Ольга Вера Дарья Елена Ирина Лидия Нина Софья",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va",
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва",
}
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "\\p{IsCyrillic}": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "\\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    "\\p{Lu}": "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    "\\p{Ll}": "àáâãäåçèéêëìíîïñòóôõöùúûüý",
}
# Kinds of names: those of patterns, and those of their parts.
NAMES = ("male", "female", "last", "first male", "first female")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hash(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256), 1, 8),
                  16, 10).cast("long")


def _pick(words: str, number: Column) -> Column:
    listed = words.split(" ")
    return F.element_at(
        F.array(*map(F.lit, listed)), (F.pmod(number, F.lit(len(listed))) + 1).cast("int")
    )


def _kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _kept(kind: Column, entity: Column) -> Column:
    out = F.lit("")
    for name, pattern in KEPT.items():
        out = F.when(kind == name, F.regexp_extract(entity, pattern, 0)).otherwise(out)
    return out


def canonical(kind: Column, body: Column) -> Column:
    """One form for all spellings of an entity."""
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"),
               F.upper(F.regexp_replace(body, "[^0-9A-Za-z]", "")))
        .when(kind == "email", F.lower(body))
        .otherwise(body)
    )


def _like(letter: Column, number: Column) -> Column:
    """A letter or digit of the same sort; anything else stays."""
    out = letter
    for sort, alphabet in reversed(ALPHABETS.items()):
        other = F.substring(
            F.lit(alphabet), (F.pmod(number, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)
        )
        if sort in ("\\p{IsCyrillic}", "\\p{IsGreek}"):
            other = F.when(letter.rlike("\\p{Lu}"), F.upper(other)).otherwise(other)
        out = F.when(letter.rlike(sort), other).otherwise(out)
    return out


def _letters(seed: Column, text: Column) -> Column:
    """A text of the same form: every letter and digit for one of the same sort."""
    each = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c, i: _like(c, _hash(seed, i.cast("string"))),
    )
    return F.array_join(each, "")


def _with_check_digit(number: Column) -> Column:
    """A card number with its last digit put right."""
    digits = F.transform(
        F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.cast("int")
    )
    rest = F.slice(digits, 2, 30)
    total = F.aggregate(
        F.transform(rest, lambda d, i: F.when(
            i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)),
        F.lit(0), lambda a, d: a + d,
    )
    last = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")
    return F.concat(F.expr("substring(drawn, 1, length(drawn) - 1)"), last)


def _first_name(first: str) -> Column:
    """Names put together after many attempts, so that they never run out."""
    each = F.transform(
        F.expr("sequence(1, 1 + attempt div 4)"),
        lambda i: _pick(first, _hash(F.col("seed"), F.lit("first"), i.cast("string"))),
    )
    return F.initcap(F.array_join(each, ""))


def _last_name(syllables: str) -> Column:
    """More syllables after many attempts, so that names never run out."""
    each = F.transform(
        F.expr("sequence(1, 3 + attempt div 4)"),
        lambda i: _pick(syllables, _hash(F.col("seed"), i.cast("string"))),
    )
    return F.initcap(F.array_join(each, ""))


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to ``kind, canonical, attempt``: also canonical, and not checked."""
    seed = F.sha2(
        F.concat_ws("\u0001", F.lit(key), "kind", "canonical", F.col("attempt").cast("string"))
        .cast("binary"), 256,
    )
    rows = entities.withColumn("seed", seed)
    octets = F.array_join(
        F.transform(
            F.split("canonical", "\\."),
            lambda o, i: (F.pmod(_hash(F.col("seed"), i.cast("string")), F.lit(254)) + 1)
            .cast("string"),
        ), ".",
    )
    script = F.when(F.col("canonical").rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    name = F.lit(None).cast("string")
    for (gender, letters), first in FIRST.items():
        name = F.when(
            (F.col("kind") == f"first {gender}") & (script == letters), _first_name(first)
        ).otherwise(name)
    for letters, syllables in SYLLABLES.items():
        name = F.when(
            F.col("kind").isin("male", "female", "last") & (script == letters), _last_name(syllables)
        ).otherwise(name)
    drawn = (
        F.when(F.col("kind") == "ip", octets)
        .when(F.col("kind").isin(*NAMES), name)
        .when(F.col("kind") == "email", F.concat(
            _letters(F.col("seed"), F.regexp_extract("canonical", "^(.*)(\\.[^.]*)$", 1)),
            F.regexp_extract("canonical", "^(.*)(\\.[^.]*)$", 2)))
        .when(F.col("kind") == "card", F.concat(
            F.substring("canonical", 1, 1),
            _letters(F.col("seed"), F.expr("substring(canonical, 2)"))))
        .otherwise(_letters(F.col("seed"), F.col("canonical")))
    )
    rows = rows.withColumn("drawn", drawn)
    checked = F.when(
        (F.col("kind") == "card") & F.expr("luhn_check(canonical)"), _with_check_digit(F.col("drawn"))
    ).otherwise(F.col("drawn"))
    return rows.withColumn("surrogate", checked).drop("seed", "drawn")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` of distinct entities ``kind, canonical``.

    In a round, of entities that drew the same surrogate the lowest stands unless the surrogate is
    taken or is an entity; all others draw again.  A round leaves a small share of the one before.
    """
    pair = ["kind", "surrogate"]
    entities = settle(entities.select("kind", "canonical").distinct(), "entities")
    real = entities.selectExpr("kind", "canonical AS surrogate")
    done: DataFrame | None = None
    todo = entities
    for attempt in range(MAX_ROUNDS):
        drawn = settle(
            draw_surrogates(todo.withColumn("attempt", F.lit(attempt)), key), "surrogates"
        )
        free = drawn.join(real, pair, "left_anti")
        if done is not None:
            free = free.join(done.select(*pair), pair, "left_anti")
        good = settle(
            free.groupBy(*pair).agg(F.min("canonical").alias("canonical")).select(
                "kind", "canonical", "surrogate"),
            "surrogates-kept",
        )
        done = good if done is None else done.union(good)
        todo = settle(
            drawn.select("kind", "canonical").join(good, ["kind", "canonical"], "left_anti"),
            "entities-left",
        )
        if not todo.take(1):
            return done
    raise ValueError("too few surrogates of some form for the entities of that form")


def _formatted(body: Column, surrogate: Column) -> Column:
    """The letters and digits of a surrogate in the places that they have in ``body``."""
    places = F.filter(F.split(body, ""), lambda c: c != "")
    return F.array_join(F.transform(places, lambda c, i: F.when(
        c.rlike("[0-9A-Za-z]"),
        F.substring(surrogate, F.length(F.regexp_replace(
            F.substring(body, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1)),
    ).otherwise(c)), "")


def _parts(kind: Column, keep: Column, body: Column) -> Column:
    """``kind, keep, body`` of the entities in one that was found: first and last name, or itself."""
    named = kind.isin("male", "female")
    words = F.split(body, " ")

    def part(kind_: Column, keep_: Column, body_: Column) -> Column:
        return F.struct(kind_.alias("kind"), keep_.alias("keep"), body_.alias("body"))

    between = F.concat(F.lit(" "), F.array_join(F.transform(
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.concat(w, F.lit(" "))), ""))
    return F.when(named & (F.size(words) > 1), F.array(
        part(F.concat(F.lit("first "), kind), keep, F.get(words, F.lit(0))),
        part(F.lit("last"), between, F.element_at(words, -1)),
    )).otherwise(F.array(part(F.when(named, "last").otherwise(kind), keep, body)))


def _entity_parts(entity: Column) -> Column:
    kind = _kind(entity)
    return bound(F.struct(kind.alias("kind"), F.coalesce(_kept(kind, entity), F.lit("")).alias("keep")),
                 lambda e: _parts(e["kind"], e["keep"], F.substring(
                     entity, F.length(e["keep"]) + 1, F.length(entity))))


def _mentions(known: Column, secret: bool) -> Column:
    """A pattern of the bodies of the secrets, or of the names, that a document is known to have."""
    chosen = F.filter(known, lambda k: (k["kind"] == "secret") == secret)
    longest_first = F.array_sort(F.array_distinct(F.transform(chosen, lambda k: k["body"])),
                                 lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(
        longest_first, lambda w: F.regexp_replace(w, "([\\\\.\\[\\]{}()*+?^$|])", "\\\\$1"))
    return F.when(F.size(chosen) > 0, F.concat(
        F.lit("(?<![\\p{L}\\p{N}_])(?:"), F.array_join(quoted, "|"), F.lit(")(?![\\p{L}\\p{N}_])")))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities``.

    ``key`` is a secret: the same key gives the same surrogates to the same entities.  If ``docs`` has
    a column ``n_entities``, it stays, and the new one has as many underscores before it as needed.
    """
    names = docs.columns
    counted = "n_entities"
    while counted.lower() in {c.lower() for c in names}:
        counted = f"_{counted}"
    marked = packed(docs, text=text_col).withColumn("_found", F.when(
        F.col("text").rlike(HINT), F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))
    ))
    has = F.coalesce(F.size("_found"), F.lit(0)) > 0
    clean = marked.where(~has).select("row.*", F.lit(0).alias(counted))
    known = F.filter(
        F.flatten(F.transform("_found", _entity_parts)),
        lambda p: p["kind"].isin("secret", *NAMES),
    )
    rows = settle(
        marked.where(has).withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_known", known),
        "with-entities",
    )
    # Secrets before anything that they may hold, names after.
    pattern = F.concat_ws(
        "|", _mentions(F.col("_known"), True), F.lit(ANY), _mentions(F.col("_known"), False))
    rows = rows.withColumn("_pattern", pattern).withColumn("_all", F.when(
        F.size("_known") > 0, F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))
    ).otherwise(F.col("_found")))
    each = rows.select("_row", "_known", F.posexplode("_all").alias("_at", "_entity"))
    again = F.get(F.filter("_known", lambda k: k["body"] == F.col("_entity")), F.lit(0))
    each = each.withColumn("_again", again).select(
        "_row", "_at", "_entity",
        F.posexplode(F.when(F.col("_again").isNotNull(), F.array(F.struct(
            F.col("_again.kind").alias("kind"), F.lit("").alias("keep"),
            F.col("_entity").alias("body")))).otherwise(_entity_parts(F.col("_entity"))))
        .alias("_part", "part"),
    ).select(
        "_row", "_at", "_part", "_entity", F.col("part.kind").alias("kind"),
        F.col("part.keep").alias("_keep"), F.col("part.body").alias("_body"),
    ).withColumn("canonical", canonical(F.col("kind"), F.col("_body")))
    each = settle(each, "found-entities")
    table = settle(surrogate_table(each.where("kind IS NOT NULL"), key), "surrogate-table")
    shaped = F.when(
        F.col("kind").isin("card", "ssn", "phone", "iban"),
        _formatted(F.col("_body"), F.col("surrogate")),
    ).otherwise(F.col("surrogate"))
    put = F.coalesce(F.concat("_keep", shaped), F.col("_entity"))
    by_row = (
        each.join(table, ["kind", "canonical"], "left")
        .groupBy("_row", "_at")
        .agg(F.array_sort(F.collect_list(F.struct("_part", put.alias("put")))).alias("_of"))
        .withColumn("put", F.array_join(F.transform("_of", lambda p: p["put"]), ""))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "put"))).alias("_puts"))
    )
    parts = F.split("text", F.col("_pattern"), -1)
    text = F.array_join(F.flatten(F.zip_with(
        parts, F.transform("_puts", lambda p: p["put"]),
        lambda part, new: F.array(part, F.coalesce(new, F.lit(""))))), "")
    kept = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    replaced = rows.join(by_row, "_row").select(*kept, F.size("_puts").alias(counted))
    return clean.unionByName(replaced)
