"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by one regular expression.  What an entity is, whatever its
spelling, is its type and canonical form, so that all its mentions get the same
surrogate: a keyed hash, spelt in the characters that the entity has (digits for
digits, small letters for small ones, hexadecimal for hexadecimal, names of the
same gender and script, card numbers that keep their check digit valid).  A
mention keeps its own punctuation.  A name is found by its form of address;
within its text the words of such names are replaced wherever they stand alone,
capitalised, too.  A card number needs a valid check digit.  All entities of the table are checked
together: of those with one surrogate, or with a surrogate that is itself an
entity, all but one are drawn again until none is left, so different entities
stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch

KEY = "tidewater"
#: Draws in an entity's own format; later ones add characters, so that there is always room.
DRAWS_IN_FORMAT = 6

#: Forms of address by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа")
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor", "доктор", "профессор")
#: Words inside a name that are none.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "y", "bin", "al")
#: Given names to choose from by gender and script, and syllables of family names by script.
GIVEN = {
    "given_m_latin": ("Adrian", "Bernard", "Conrad", "Desmond", "Edgar", "Felix", "Gilbert", "Hector", "Ivor", "Julius", "Lambert", "Marius", "Norbert", "Oscar", "Roland", "Victor"),
    "given_f_latin": ("Agatha", "Beatrice", "Clara", "Dorothea", "Edith", "Flora", "Gerda", "Helena", "Irene", "Judith", "Laura", "Miriam", "Nora", "Olivia", "Rosa", "Viola"),
    "given_n_latin": ("Alexis", "Ariel", "Charlie", "Dominique", "Eden", "Frankie", "Jackie", "Kim", "Lou", "Morgan", "Noel", "Quinn", "Robin", "Sascha", "Toni", "Yael"),
    "given_n_cyrillic": ("Валя", "Вася", "Гена", "Женя", "Миша", "Паша", "Рома", "Саня", "Саша", "Сима", "Слава", "Стася", "Тася", "Тоня", "Шура", "Юля"),
    "given_m_cyrillic": ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Макар", "Никита", "Олег", "Павел", "Роман", "Степан"),
    "given_f_cyrillic": ("Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gar", "hol", "ken", "lin", "mar", "nor", "pel", "ran", "sol", "tor", "van", "wel", "zan"),
    "cyrillic": ("ба", "вол", "гор", "дан", "жел", "зор", "кол", "лен", "мар", "нов", "пет", "рад", "сон", "тор", "хар", "чер"),
}

_NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}{2}))++"
_TITLES = rf"(?:(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.? )+"
_LABEL = r"(?i:password|passwd|pwd)\s?[=:]\s?[\"']?"
_LABEL_DIGIT = r"(?i:secret|token|api[_-]?key)\s?[=:]\s?[\"']?"
_LOCAL, _HOST = r"[\p{L}\p{M}0-9._%+-]", r"[\p{L}\p{M}0-9-]"
#: Entities in the order in which they're tried at a place; no quantifier that can be tried again from every character of a long run.
PATTERNS = {
    "secret": rf"(?<![\p{{L}}0-9]){_LABEL}[^\s\"',;|]{{4,}}+|(?<![\p{{L}}0-9]){_LABEL_DIGIT}(?=[^\s\"',;|0-9]*+[0-9])[^\s\"',;|]{{8,}}+"
    r"|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}+|(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}+"
    r"|(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@{_HOST}+(?:\.{_HOST}+)*\.\p{{L}}{{2,}}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:2[2-7]|[3-6][0-9])[0-9]{2}[ -]?(?:[0-9]{4}[ -]?){2}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": rf"(?<!\p{{L}}){_TITLES}(?:(?:van|von|de|del|della|di|da|du|bin|al) (?:(?:der|den|la|le) )?)?{_NAME}(?: (?:(?:{'|'.join(PARTICLES)}) )*(?!{_TITLES}){_NAME})*+",
}
ENTITY = "|".join(PATTERNS.values())
#: A capitalised word, which can be one of a name.
WORD = rf"(?<!\p{{L}}){_NAME}"
#: What every entity holds; texts without it aren't searched.
HINT = rf"[0-9@]|(?i:password|passwd|pwd)|AKIA|gh[pousr]_|sk-|[A-Fa-f]{{32}}|{_TITLES}"


def _kind(mention: Column) -> Column:
    """The type of a mention, by the patterns in their order."""
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(mention.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


def _body(mention: Column, kind: Column) -> Column:
    """What is replaced of a mention: all but a secret's name or known prefix, and a name's title."""
    secret = F.regexp_replace(mention, rf"\A(?:{_LABEL}|{_LABEL_DIGIT}|AKIA|gh[pousr]_|sk-)", "")
    return F.when(kind == "secret", secret).when(kind == "name", F.regexp_replace(mention, rf"\A{_TITLES}", "")).otherwise(mention)


def _name_words(body: Column) -> Column:
    return F.filter(F.split(body, " "), lambda w: ~w.isin(*PARTICLES))


def _parts(kind: Column, mention: Column, body: Column) -> Column:
    """The entities of a mention, as (type, canonical form): a name has one for each word, others have one."""
    digits, compact = F.regexp_replace(body, "[^0-9]", ""), F.regexp_replace(body, "[ -]", "")
    canonical = F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "email", F.lower(body)).when(kind == "iban", compact).otherwise(body)
    title = F.substring(mention, F.lit(1), F.length(mention) - F.length(body))
    gender = F.when(title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(MALE)})[. ]"), "m").when(title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(FEMALE)})[. ]"), "f").otherwise("n")
    script = F.when(body.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    words = _name_words(body)
    family = F.struct(F.concat(F.lit("family_"), script).alias("kind"), F.lower(F.element_at(words, -1)).alias("canonical"))
    given = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.struct(F.concat(F.lit("given_"), gender, F.lit("_"), script).alias("kind"), F.lower(w).alias("canonical")))
    name = F.concat(given, F.array(family))
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"))))


def _stream(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    """Hexadecimal digits from a keyed hash, two for each character of the entity and some more."""
    blocks = F.sequence(F.lit(0), (F.length(canonical) / 60).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canonical, draw.cast("string"), b.cast("string")), 512)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(stream.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))


def _spelt(canonical: Column, stream: Column, kept: Column) -> Column:
    """The canonical form with each letter and digit from ``kept`` on drawn anew within its class."""
    hexadecimal = canonical.rlike(r"\A(?:[0-9a-f]+|[0-9A-Fa-f]{32,})\z")
    # characters and their bytes as arrays, made once: an entity can be long
    pairs = F.arrays_zip(F.regexp_extract_all(canonical, F.lit("(?s)."), 0).alias("c"), F.slice(F.regexp_extract_all(stream, F.lit(".."), 0), F.lit(1), F.length(canonical)).alias("b"))

    def char(pair: Column, i: Column) -> Column:
        c, b = pair["c"], F.conv(pair["b"], 16, 10).cast("int")
        drawn = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[a-z]"), F.when(hexadecimal, _pick("abcdef", b)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", b)))
            .when(c.rlike("[A-Z]"), F.when(hexadecimal, _pick("ABCDEF", b)).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", b))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(c)
        )
        return F.when(i < kept, c).otherwise(drawn)

    return F.array_join(F.transform(pairs, char), "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _syllables(parts: tuple[str, ...], stream: Column, n: Column) -> Column:
    table = F.array(*(F.lit(p) for p in parts))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(table, _byte(stream, i) % len(parts) + 1)), "")


def surrogate(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    """The canonical form that stands for an entity at its ``draw``-th draw."""
    stream = _stream(key, kind, canonical, draw)
    tail = F.when(draw >= DRAWS_IN_FORMAT, _pick("0123456789", _byte(stream, F.lit(0)))).otherwise(F.lit(""))
    domain = F.element_at(F.split(canonical, "@"), -1)
    user = F.element_at(F.split(canonical, "@"), 1)
    top = F.regexp_extract(domain, r"\.\p{L}+\z", 0)
    spelt = _spelt(canonical, stream, F.lit(0))
    host = F.substring(spelt, F.length(user) + 2, F.length(domain) - F.length(top))
    email = F.concat(F.substring(spelt, F.lit(1), F.length(user)), tail, F.lit("@"), host, top)
    octets = F.array_join(F.array(*((_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4))), ".")
    start = F.substring(_spelt(canonical, stream, F.lit(1)), F.lit(1), F.length(canonical) - 1)
    valid = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(start, d.cast("string"))))
    card = F.when(_luhn(canonical), F.concat(start, F.element_at(valid, 1).cast("string"))).otherwise(spelt)
    out = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "iban", F.concat(_spelt(canonical, stream, F.lit(2)), tail))
    out = out.when(kind == "phone", F.concat(_spelt(canonical, stream, F.when(F.length(canonical) > 10, F.length(canonical) - 10).otherwise(0)), tail))
    for script, parts in SYLLABLES.items():
        family = _syllables(parts, stream, draw + 3)
        out = out.when(kind == f"family_{script}", F.initcap(family))
        for gender in "mfn":
            names = GIVEN[f"given_{gender}_{script}"]
            given = F.element_at(F.array(*(F.lit(n) for n in names)), _byte(stream, F.lit(0)) % len(names) + 1)
            more = F.when(draw > 0, F.concat(F.lit("-"), F.initcap(family))).otherwise(F.lit(""))
            out = out.when(kind == f"given_{gender}_{script}", F.concat(given, more))
    return out.otherwise(F.concat(spelt, tail))


def _cased(word: Column, one: Column) -> Column:
    """A surrogate in capitals where the word is."""
    return F.when(word == F.upper(word), F.upper(one)).otherwise(one)


def _render(kind: Column, mention: Column, body: Column, surrogates: Column) -> Column:
    """A mention with its surrogates: the k-th letter or digit of its body is the k-th of the surrogate, and what is left of that follows."""
    words = F.array_join(F.zip_with(_name_words(body), surrogates, _cased), " ")
    one = F.element_at(surrogates, 1)
    chars = F.regexp_replace(one, "[^A-Za-z0-9]", "")
    inner = F.split(body, "")
    # how many letters or digits come before each character
    counted = F.aggregate(
        inner,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["out"], F.substring(chars, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(chars, acc["n"] + 1, F.length(chars))),
    )
    spelt = F.when(kind.isin("card", "ssn", "phone", "iban"), counted).when(kind == "name", words).otherwise(one)
    return F.concat(F.substring(mention, F.lit(1), F.length(mention) - F.length(body)), spelt)


def assign_surrogates(entities: DataFrame, scratch: Scratch, key: str = KEY) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical), no two of a kind alike and none an entity itself."""
    known = entities.select("kind", F.col("canonical").alias("surrogate"))
    settled: DataFrame | None = None
    waiting, draw = entities, 0
    while True:
        drawn = scratch.save(waiting.select("kind", "canonical", surrogate(key, F.col("kind"), F.col("canonical"), F.lit(draw)).alias("surrogate")), f"draw-{draw}")
        taken = known if settled is None else known.unionByName(settled.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        good = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canonical", "surrogate")
        settled = scratch.save(good if settled is None else settled.unionByName(good), f"settled-{draw}")
        rest = drawn.join(settled.select("kind", "canonical"), ["kind", "canonical"], "left_anti").select("kind", "canonical")
        if not rest.take(1):
            return settled
        waiting, draw = rest, draw + 1


def replace_personal_data(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """``docs`` with the personal data of their text replaced; all columns and rows stay.

    Null and empty texts stay as they are, and so do texts without entities.
    Repeated rows get the same text.  Empty table: no rows.  Columns of any name
    are carried along.  A very long text takes time in proportion to its length
    and memory for its mentions.  A common word that is also part of a name in
    the same text is replaced where it is capitalised.  An entity's surrogate depends on the key and, only where
    two entities collide, on the other entities of the table.  Texts with
    entities are shuffled once, by a digest of the text; copies of one text are
    one row until then, and a hot one is split by the skew join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    text = F.col(column)
    # names of our own that no column has
    mark = "__tw"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    k, found, named = f"{mark}_k", f"{mark}_found", f"{mark}_named"
    has = F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))
    # the rows with entities, a small part, are searched in three steps and so found once
    hits = scratch.save(docs.where(has).withColumn(k, F.sha2(text, 256)), "hits")
    mentions = hits.select(F.col(k).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), 0))).alias("mention")).distinct()
    mentions = scratch.save(mentions, "mentions")
    kinds = mentions.select("mention").distinct().withColumn("kind", _kind(F.col("mention"))).withColumn("body", _body(F.col("mention"), F.col("kind")))
    kinds = kinds.where((F.col("kind") != "card") | F.coalesce(_luhn(F.regexp_replace("body", "[^0-9]", "")), F.lit(False)))
    kinds = scratch.save(kinds.withColumn("parts", _parts(F.col("kind"), F.col("mention"), F.col("body"))), "kinds")
    parts = kinds.select("mention", F.posexplode("parts").alias("at", "part")).select("mention", "at", "part.kind", "part.canonical")
    chosen = assign_surrogates(parts.select("kind", "canonical").distinct(), scratch, key)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"])
    spelt = parts.join(chosen, ["kind", "canonical"]).groupBy("mention").agg(ordered.alias("surrogates"))
    rendered = kinds.join(spelt, "mention").select("mention", _render(F.col("kind"), F.col("mention"), F.col("body"), F.col("surrogates")).alias("new"))
    by_text = mentions.join(scratch.save(rendered, "rendered"), "mention").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("new"))
    # the words of a text's names; one that is a family and a given name goes by the former
    words = mentions.join(parts.where("kind LIKE 'family%' OR kind LIKE 'given%'").select("mention", "kind", "canonical").distinct(), "mention")
    words = words.join(chosen, ["kind", "canonical"]).groupBy("k", "canonical").agg(F.min(F.struct("kind", "surrogate"))["surrogate"].alias("surrogate"))
    words = words.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "surrogate"))).alias("words"))
    by_text = scratch.save(by_text.join(words, "k", "left").select(F.col("k").alias(k), F.col("new").alias(found), F.col("words").alias(named)), "by-text")
    joined = hits.join(by_text, k, "left")

    def spliced(pattern: str, change) -> Column:
        changed = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), change)
        return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(changed, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    def mentioned(m: Column) -> Column:
        return F.try_element_at(F.col(found), m)

    def word(w: Column) -> Column:
        return _cased(w, F.coalesce(F.try_element_at(F.col(named), F.lower(w)), w))

    # a mention, or else a word of a name, whole or between its hyphens
    either = lambda m: F.coalesce(mentioned(m), F.when(F.try_element_at(F.col(named), F.lower(m)).isNotNull(), word(m)), F.array_join(F.transform(F.split(m, r"(?<=['’-])|(?=['’-])"), word), ""))
    whole = F.when(F.col(found).isNull(), text).when(F.col(named).isNull(), spliced(ENTITY, lambda m: F.coalesce(mentioned(m), m))).otherwise(spliced(f"{ENTITY}|{WORD}", either))
    replaced = joined.withColumn(column, whole).select(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.where(~has).unionByName(replaced)
