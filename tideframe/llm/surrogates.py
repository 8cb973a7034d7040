"""Surrogates for personal data, in DataFrame expressions only.

Entities are found by pattern. Each distinct entity of the corpus gets one replacement, derived from a keyed hash, of
the same type and format: digits stay digits, letters keep case and script, punctuation stays, card numbers keep their
issuer digit and pass the Luhn check, addresses stay addresses, and names keep title, gender and script. The same entity
gets the same replacement everywhere: mail addresses are the same whatever their case, and each word of a name is an
entity of its own, whatever its title, so that all mentions of a surname share one stem. Where a text gives a name a
title, its words are replaced in the rest of that text as well, without a title too. Collision checks see to it that distinct entities get distinct replacements and
that no replacement is an entity of the corpus; what collides is derived again in another round.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.llm.common import documents, shared_dir, stage, text_of

# Titles by gender, and syllables that names are made of.
_TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "Señora", "Madame", "г-жа", "Fräulein", "Lady", "Dame", "Madam", "Doña", "Dra", "Sister", "Госпожа", "госпожа"], "m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "г-н", "Mister", "Herrn", "Sir", "Don", "Brother", "Господин", "господин"], "": ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Mx", "Rev", "Judge", "Senator", "Captain", "Capt", "доктор", "профессор"]}
_SYLLABLES = {
    "latin": ["al", "ber", "cor", "dan", "el", "far", "gal", "hel", "is", "jor", "kar", "lor", "mar", "nor", "ol", "per", "ros", "sal", "tor", "vel"],
    "cyrillic": ["ал", "бор", "вел", "гор", "дар", "ел", "жан", "зор", "ил", "кар", "лев", "мир", "нор", "ол", "пет", "рос", "сав", "тор", "ул", "яр"],
}
_ENDINGS = {("latin", "f"): "ina", ("latin", "m"): "on", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "ов"}

_ALL_TITLES = "|".join(t for g in _TITLES.values() for t in g)
#: Characters that a title begins with.
_FIRST = "".join(sorted({t[0] for g in _TITLES.values() for t in g}))
_PARTICLES = "von|van|der|den|de|del|della|di|da|du|la|le|zu|al|bin|ibn"
#: A word of a name, and a name of some such words, initials and particles.
_WORD = r"\p{Lu}(?:\p{L}+(?:['’]\p{L}{2,})*|(?:['’]\p{L}{2,})+)"
_NAME = rf"(?:\p{{Lu}}\.[ ]?){{0,3}}(?:(?:{_PARTICLES}) ){{0,3}}{_WORD}(?:(?: (?:\p{{Lu}}\.[ ]?){{0,3}}(?:(?:{_PARTICLES}) ){{0,3}}|-){_WORD}){{0,4}}"
_TITLED = rf"(?:(?:{_ALL_TITLES})\.? ){{1,6}}"
#: Country code and area in parentheses; after a plus sign; groups of 3, 3 and 4; with a leading 0; French pairs.
_PHONE = r"""(?<![\w+])(?:\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)
|\+(?=(?:[ ()./-]{0,2}\d){8})\d{1,3}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,5})){2,7}
|(?<!\d[.,/-])(?:00\d{1,3}[ .-]|\d{1,3}[ .-])?(?:\(\d{2,5}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)
|(?<!\d[.,/-])\(0\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)
|(?<!\d[.,/-])0\d{1,4}(?:[ /-]\d{5,8}|[ -]\d{3,4}[ -]\d{3,5})(?!\d)
|(?<!\d[.,/-])0\d(?:[ .-]\d{2}){4}(?![.-]?\d))""".replace("\n", "")
#: type -> pattern; where several could match, the first does.
PATTERNS = {
    # A local part has 64 characters at most and begins a run of letters and digits, so that long runs are passed once.
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}",
    "secret": r"(?<=[=:\s\"'])(?<=(?:password|passwd|pwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/-]{8,}",
    "phone": _PHONE,
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d)(?!\.\d)",
    "card": r"(?<![\d-])(?:[2-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{4,5})(?!\d)",
    "name": rf"(?<!\w)(?=[{_FIRST}]){_TITLED}{_NAME}",
}
_NUMERIC = ("phone", "ipv4", "card")
#: All patterns in their order; those of numbers are tried only where a number can begin.
ANY = "|".join([*(f"(?:{PATTERNS[k]})" for k in ("email", "secret")), rf"(?=[\d+(])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in _NUMERIC)})", f"(?:{PATTERNS['name']})"])
#: A cheap sign that a text may hold an entity.
_HINT = rf"[@=:]|\d{{4}}|\(\d|\d\.\d|\+\d|\d{{2}}[ ./-]\d{{2}}|(?<!\w)(?=[{_FIRST}])(?:{_ALL_TITLES})\.? (?:\p{{Lu}}|(?:{_PARTICLES}|{_ALL_TITLES})[ .])"


def entity_type(value: Column) -> Column:
    """Type of a found entity, by its own shape; what fits no other shape was found as a secret."""
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _number(digest: Column, i: Column) -> Column:
    """The i-th number (0 to 255) of a hex digest, going round."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(value: Column, digest: Column, keep: Column | int = 0) -> Column:
    """Other characters of the same kind from position `keep` on; hexadecimal stays hexadecimal."""
    letters = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(6)).otherwise(F.lit(26))

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i) + F.floor(i / 32).cast("int") * 7
        code = F.ascii(c)
        return (
            F.when(i < keep, c)
            .when(c.between("0", "9"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.between("a", "z"), F.chr(F.lit(97) + F.pmod(n, letters)))
            .when(c.between("A", "Z"), F.chr(F.lit(65) + F.pmod(n, letters)))
            .when((code >= 0x430) & (code <= 0x44F), F.substring(F.lit("абвгдежзийклмнопрстуфхцчшщъыьэюя"), F.pmod(n, F.lit(32)) + 1, F.lit(1)))
            .when((code >= 0x410) & (code <= 0x42F), F.substring(F.lit("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"), F.pmod(n, F.lit(32)) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _card(value: Column, digest: Column) -> Column:
    """Same issuer digit and grouping; the last digit makes the Luhn sum whole."""
    changed = _alike(value, digest, 1)
    digits = F.reverse(F.split(F.regexp_replace(changed, r"\D", ""), ""))
    doubled = F.transform(digits, lambda c, i: F.when(i == 0, F.lit(0)).otherwise(F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int"))))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x)
    return F.concat(F.substring(changed, F.lit(1), F.length(changed) - 1), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _address(value: Column, digest: Column) -> Column:
    return F.concat_ws(".", *((_number(digest, F.lit(i)) % 254 + 1).cast("string") for i in range(4)))


def _email(value: Column, digest: Column, domain_digest: Column) -> Column:
    """A mailbox of the same form in a reserved domain, which stands for the same domain everywhere."""
    n = F.conv(F.substring(domain_digest, F.lit(1), F.lit(8)), 16, 10)
    domain = F.concat(F.lit("m"), n, F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _number(domain_digest, F.lit(8)) % 3 + 1))
    return F.concat(_alike(F.substring_index(value, "@", 1), digest), F.lit("@"), domain)


def _stem(value: Column, digest: Column, rounds: Column) -> Column:
    """Stem of the replacement of a name's word."""

    def made(script: str) -> Column:
        pool = F.array(*map(F.lit, _SYLLABLES[script]))
        picks = F.transform(F.sequence(F.lit(0), F.lit(3) + rounds), lambda i: F.element_at(pool, _number(digest, i) % len(_SYLLABLES[script]) + 1))
        return F.initcap(F.array_join(picks, ""))

    return F.when(value.rlike(r"^\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common; of a name, that of one word."""
    word = F.regexp_replace(F.lower(value), "’", "'")
    return F.when(kind == "email", F.lower(value)).when(kind == "name", F.regexp_replace(word, "(?<=ов|ев|ёв|ин|ын)а$", "")).otherwise(value)


def _rendered(word: Column, stem: Column, female: Column) -> Column:
    """The replacement of a word of a name, with the ending of its gender and the capitals of the word."""
    ending = F.lit(_ENDINGS["latin", "m"])
    for (script, gender), text in _ENDINGS.items():
        ending = F.when((female if gender == "f" else ~female) & (stem.rlike(r"^\p{IsCyrillic}") if script == "cyrillic" else ~stem.rlike(r"^\p{IsCyrillic}")), F.lit(text)).otherwise(ending)
    return F.when(word == F.upper(word), F.upper(F.concat(stem, ending))).otherwise(F.concat(stem, ending))


def surrogate(kind: Column, value: Column, key: str, rounds: Column) -> Column:
    """Replacement of an entity (of a name's word, its stem); depends on key, type, value and round only."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, rounds.cast("string"), F.lit(key)), 256)
    domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.lower(F.substring_index(value, "@", -1)), F.lit(key)), 256)
    return (
        F.when(kind == "email", _email(value, digest, domain))
        .when(kind == "ipv4", _address(value, digest))
        .when(kind == "card", _card(value, digest))
        .when(kind == "phone", _alike(value, digest, F.when(value.rlike(r"^\+\d{1,3}\D"), F.length(F.regexp_extract(value, r"^(\+\d+)", 1))).when(value.startswith("+"), 2).otherwise(0)))
        .when(kind == "name", _stem(value, digest, rounds))
        .otherwise(_alike(value, digest))
    )


#: Round from which surrogates grow.
WIDER = 12


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(value, kind, surrogate) for distinct canonical entities (value, kind), with collisions resolved over rounds.

    Of entities that meet in one surrogate, the smallest keeps it; the others get another in the next round. From round
    WIDER on, a surrogate that keeps its entity's format takes some characters more each round, so that rounds end also
    where a format has too few values.
    """
    taken: list[DataFrame] = []
    left = entities
    # Canonical forms of all entities, and of those that end like a made name the stems.
    endings = "(?:" + "|".join(_ENDINGS.values()) + ")$"
    used = entities.select(F.explode(F.array(F.col("value"), F.when(F.col("kind") == "name", F.regexp_replace("value", endings, "")))).alias("_used")).where("_used IS NOT NULL").distinct()
    lowered = F.when(F.col("kind").isin("email", "name"), F.lower("surrogate")).otherwise(F.col("surrogate"))
    for i in count():
        made = surrogate(F.col("kind"), F.col("value"), key, F.lit(i))
        if i >= WIDER:
            more = F.substring(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value", F.lit(str(i))), 256), 1, 15), 16, 10), 1, i - WIDER + 2)
            # A mail address takes them in front, so that it stays one; addresses and card numbers of any length stay as they are.
            made = F.when(F.col("kind") == "email", F.concat(more, made)).when(F.col("kind").isin("phone", "secret", "card"), F.concat(made, more)).otherwise(made)
        tried = left.select("value", "kind", made.alias("surrogate"))
        free = tried.withColumn("_used", lowered).join(used, "_used", "left_anti").drop("_used")
        for earlier in taken:
            free = free.join(earlier.select("surrogate"), "surrogate", "left_anti")
        first = free.withColumn("rank", F.row_number().over(Window.partitionBy("surrogate").orderBy("value", "kind"))).where("rank = 1").drop("rank")
        taken.append(stage(first, f"surrogates{i}"))
        left = stage(left.join(taken[-1].select("value", "kind"), ["value", "kind"], "left_anti"), f"open{i}")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)
    raise AssertionError("rounds end when no entity is left")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, text with replacements, n_entities and, for each type, how many; one row for each row.

    Null text stays null with no entities. Texts are matched by digest, so repeated texts and rows that repeat an id
    are served alike. Other columns are not read. An empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    found = F.when(F.col("text").rlike(_HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    marked = base.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    # Texts are searched once; those with entities go on as the pieces between them.
    some_found = F.size("found") > 0
    marked = stage(marked.select(id_col, F.when(~some_found, F.col("text")).alias("text"), "found", F.when(some_found, F.split("text", ANY, -1)).alias("pieces"), F.when(some_found, F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")), "marked")
    some = marked.where(F.size("found") > 0)
    used = stage(some.select("digest", F.explode(F.array_distinct("found")).alias("raw")).distinct(), "used")
    kinds = used.select("raw").distinct().withColumn("kind", entity_type(F.col("raw")))
    is_name = F.col("kind") == "name"
    rest = F.regexp_replace("raw", rf"^{_TITLED}", "")
    titles = F.regexp_extract_all("raw", F.lit(rf"(?:{_ALL_TITLES})(?=\.? )"), F.lit(0))
    typed = stage(kinds.select("raw", "kind", F.when(is_name, F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0))).otherwise(F.array("raw")).alias("words"), F.when(is_name, rest).alias("rest"), F.when(is_name, F.arrays_overlap(titles, F.array(*map(F.lit, _TITLES["f"])))).otherwise(False).alias("female")), "typed")
    parts = typed.select("raw", "kind", F.posexplode("words").alias("at", "word"), "female").withColumn("value", canonical(F.col("kind"), F.col("word")))
    entities = stage(parts.select("value", "kind").distinct(), "entities")
    table = assign(entities, key)
    made = F.when(is_name, _rendered(F.col("word"), F.col("surrogate"), F.col("female"))).otherwise(F.col("surrogate"))
    words = parts.join(table, ["value", "kind"]).groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("at", "word", made.alias("made")))).alias("words"))
    # A name is put together again around its new words; initials become others.
    letter = lambda c: F.when(c.rlike(r"\p{Lu}\."), F.concat(F.regexp_extract(c, r"^(.*?)\p{Lu}\.", 1), _alike(F.regexp_extract(c, r"(\p{Lu}\..*)$", 1), F.sha2(F.concat(F.lit(key), c), 256), 0))).otherwise(c)
    gaps = F.transform(F.split("rest", _WORD, -1), letter)
    name = F.concat(F.regexp_extract("raw", rf"^({_TITLED})", 1), F.array_join(F.zip_with(gaps, "words", lambda g, w: F.concat(g, F.coalesce(w["made"], F.lit("")))), ""))
    mentions = F.flatten(F.transform("words", lambda w: F.array(F.struct(w["word"].alias("word"), w["made"].alias("made")), F.struct(F.upper(w["word"]).alias("word"), F.upper(w["made"]).alias("made")), F.struct(F.initcap(w["word"]).alias("word"), F.initcap(w["made"]).alias("made")))))
    replaced = typed.drop("words").join(words, "raw").select("raw", F.struct("kind", F.when(is_name, name).otherwise(F.col("words")[0]["made"]).alias("surrogate"), F.when(is_name, mentions).otherwise(F.slice(mentions, 1, 0)).alias("mentions")).alias("hit"))
    by_text = used.join(replaced, "raw").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("raw", "hit"))).alias("map"))
    counts = [f"n_{k}" for k in PATTERNS]
    joined = some.join(by_text, "digest").withColumn("hits", F.transform("found", lambda v: F.element_at(F.col("map"), v)))
    # Names that have a title somewhere in the text are replaced between the entities, too; the first mention decides.
    between = joined.withColumn("mentions", F.flatten(F.transform("hits", lambda h: h["mentions"])))
    named = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(F.array_distinct(F.transform("mentions", lambda m: m["word"])), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    bare = lambda p: F.regexp_extract_all(p, F.col("named"), F.lit(0))
    again = lambda p: F.array_join(F.zip_with(F.split(p, F.col("named"), -1), F.transform(bare(p), lambda w: F.element_at(F.filter("mentions", lambda m: m["word"] == w), 1)["made"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    some_names = F.size("mentions") > 0
    between = between.withColumn("named", named).withColumn("n_bare", F.when(some_names, F.aggregate("pieces", F.lit(0), lambda n, p: n + F.size(bare(p)))).otherwise(0)).withColumn("pieces", F.when(some_names, F.transform("pieces", again)).otherwise(F.col("pieces")))
    pieces = F.zip_with("pieces", "hits", lambda p, h: F.concat(p, F.coalesce(h["surrogate"], F.lit(""))))
    of_kind = [(_of_kind(k) + (F.col("n_bare") if k == "name" else F.lit(0))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    changed = between.select(id_col, F.array_join(pieces, "").alias("text"), (F.size("found") + F.col("n_bare")).cast("long").alias("n_entities"), *of_kind)
    same = marked.where(F.size("found") == 0).select(id_col, "text", F.lit(0).cast("long").alias("n_entities"), *(F.lit(0).cast("long").alias(c) for c in counts))
    return same.unionByName(changed)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir), key=spark.conf.get("tideframe.surrogates.key", "tideframe"))
