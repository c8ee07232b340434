"""PII: detected entities get keyed surrogates of their own type, format, script and gender.

Entities are found by patterns: e-mail and IP addresses, phone, card, account and social
security numbers, access keys, passwords and tokens up to their closing quote or white
space, and names after a title. The words of a name found in a document are then found
wherever they stand in it, spelled alike. Each is
reduced to what it denotes (a phone number to its digits, a name to its words), so
mentions that differ in form stay the same person or number. Its surrogate is drawn from
a keyed hash: digits stay digits, letters stay letters of their case and script, a first
name ends as names of its gender do, a phone number keeps its first digit, a card
number a valid check digit, an IP address
falls into the reserved range, a mail address under `example`. A name's word has one
surrogate, whatever its titles; its gender is that of most mentions, none if they are even.

All entities of the corpus are drawn together and checked: where two would share a
surrogate, or a surrogate is itself an entity of the corpus, all but one draw again. So
different entities stay different, and the same entity is the same in every document.

Defined cases: a null text stays null, an empty one empty. Text outside entities is kept
to the character. Rows with the same id and text get the same result. Other columns are
kept, whatever their names; an empty table gives an empty result. The key is a secret of
the caller: without it surrogates cannot be tied to what they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise

# What entities look like, tried in this order, and the titles of names.
MALE = "Mr|Sir|Herr|Señor|Sr|Don|Monsieur"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Doña|Madame|Mme"
ANY = "Dr|Prof"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}])(?i:password|passwd|token|secret|api_key)[\"']?\s{0,2}[=:]\s{0,2}"
              r"(?:\"(?=[^\"\n]*[\p{L}\p{N}])(?:[^\"\\\n]++|\\.){1,500}+\"|'(?=[^'\n]*[\p{L}\p{N}])(?:[^'\\\n]++|\\.){1,500}+'"
              r"|[\"']?(?=[^\s\"']*[\p{L}\p{N}])[^\s\"']*[^\s\"'.,;:!?)\]}>])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?!\d)"
             r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])"
             r"|(?<![\w.\-])(?=0(?: ?\d){8,14}(?! ?\d))0\d{1,4}(?: \d{2,8}){1,5}(?![\d\-])",
    "social": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "ip6": rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{2,7}}:|:(?::{HEX}){{2,7}})(?![\w:]|\.\d)",
    "card": r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "name": rf"(?<!\w)(?:{MALE}|{FEMALE}|{ANY})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE = rf"^(?:{MALE}|{FEMALE}|{ANY})\.? "
_SECRET_HEAD = r"^\w+[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
_SECRET_TAIL = r"[\"']$"
# A text's words and what is between them.
_TOKENS = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"
# Ranges of letters of one case in one script: first code point and number of letters.
SCRIPTS = (("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 17), ("Α", 17), ("à", 23), ("À", 23))
ENDINGS = {"male": ("o", "an", "us", "er", "ik", "on", "or", "im"), "female": ("a", "ia", "elle", "ine", "ana", "eth", "issa", "ora")}

ROUNDS = 20


def _kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def mentions(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with `__found`, the entities of a text in order."""
    return docs.withColumn("__found", F.regexp_extract_all(F.col(text), F.lit(f"({PATTERN})"), 1))


def _expanded(address: Column) -> Column:
    """The 32 hexadecimal digits of an IP address of version 6."""
    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda x: x != "")

    sides = F.split(F.lower(address), "::")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(x, 4, "0")), "")


def _parts(mention: DataFrame) -> DataFrame:
    """(entity) to (entity, kind, gender, part, whole): what each part of a mention denotes.

    All have one part but names, whose words are told apart: the last is a family name and
    has no gender.
    """
    entity = F.col("entity")
    bare = F.regexp_replace(entity, _TITLE, "")
    gender = F.when(entity.rlike(rf"^(?:{FEMALE})\.? "), "female").when(entity.rlike(rf"^(?:{MALE})\.? "), "male").otherwise("any")
    rows = mention.withColumn("kind", _kind(entity)).withColumn("gender", F.when(F.col("kind") == "name", gender).otherwise(""))
    denoted = (
        F.when(F.col("kind") == "name", F.split(bare, " "))
        .when(F.col("kind").isin("phone", "card", "social"), F.array(F.regexp_replace(entity, r"\D", "")))
        .when(F.col("kind") == "account", F.array(F.regexp_replace(entity, " ", "")))
        .when(F.col("kind") == "secret", F.array(F.regexp_replace(entity, rf"{_SECRET_HEAD}|{_SECRET_TAIL}", "")))
        .when(F.col("kind") == "email", F.array(F.lower(entity)))
        .when(F.col("kind") == "ip6", F.array(_expanded(entity)))
        .otherwise(F.array(entity))
    )
    rows = rows.select("entity", "kind", "gender", F.size(denoted).alias("n"), F.posexplode(denoted).alias("part", "whole"))
    first = (F.col("kind") == "name") & (F.col("part") < F.col("n") - 1)
    return rows.select("entity", "kind", F.when(first, F.col("gender")).otherwise("").alias("gender"), "part", "whole")


def _drawn(whole: Column, kind: Column, gender: Column, attempt: Column, key: str) -> Column:
    """A surrogate of the same shape, from the keyed hash of kind, entity and attempt."""
    def stream(block: Column) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(key), kind, whole, attempt.cast("string"), block.cast("string")), 256)

    local = F.when(kind == "email", F.substring_index(whole, "@", 1)).otherwise(whole)
    # Short shapes run out of free values; those without a fixed length then grow.
    grows = (attempt > 3) & ~kind.isin("phone", "card", "social", "key", "account", "ip", "ip6")
    local = F.when(grows, F.repeat(local, attempt - 2)).otherwise(local)
    blocks = F.sequence(F.lit(0), F.floor(F.length(local) / 16).cast("int"))
    noise = F.array_join(F.transform(blocks, stream), "")
    chars = F.split(local, "")

    def char(c: Column, i: Column) -> Column:
        r = F.conv(F.substring(noise, 4 * i + 1, F.lit(4)), 16, 10).cast("int")
        # Letters of other scripts become Latin ones of their case.
        other = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), r % 26 + 1, F.lit(1))
        out = F.when(c.rlike(r"^[0-9]$"), (r % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(other)).when(
            c.rlike(r"^[\p{L}\p{N}]$"), other).otherwise(c)
        for first, size in SCRIPTS:
            at = F.ascii(c)
            inside = (at >= ord(first)) & (at < ord(first) + size)
            hexed = (kind == "secret") & whole.rlike("^[0-9a-f]+$") & F.lit(first == "a")
            span = F.when(hexed, 6).otherwise(size)
            letters = F.substring(F.lit("".join(chr(ord(first) + k) for k in range(size))), r % span + 1, F.lit(1))
            out = F.when(inside, letters).otherwise(out)
        return out

    shaped = F.array_join(F.transform(chars, char), "")

    def octet(k: int) -> Column:
        return F.conv(F.substring(noise, 1 + 4 * k, 4), 16, 10).cast("int")

    address = F.concat_ws(".", (octet(0) % 15 + 240).cast("string"), *[(octet(k) % 254 + 1).cast("string") for k in (1, 2, 3)])
    tail = F.substring_index(whole, ".", -1)
    mail = F.concat(shaped, F.lit("@example."), F.when(tail.isin("com", "net", "org"), tail).otherwise("com"))
    head = F.concat(F.substring(whole, F.lit(1), F.lit(1)), F.substring(shaped, F.lit(2), F.length(whole) - 2))
    # The check digit: every second digit from the right is doubled, 9 taken off above 9.
    total = F.aggregate(F.reverse(F.split(head, "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda s, c: F.struct(
        (s["sum"] + F.when(s["i"] % 2 == 0, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))).alias("sum"),
        (s["i"] + 1).alias("i")))["sum"]
    card = F.concat(head, F.pmod(10 - total % 10, F.lit(10)).cast("string"))
    ending = F.when(gender == "male", F.element_at(F.array(*map(F.lit, ENDINGS["male"])), octet(0) % 8 + 1)).otherwise(
        F.element_at(F.array(*map(F.lit, ENDINGS["female"])), octet(0) % 8 + 1))
    latin = whole.rlike("^[A-Za-zÀ-ÿ]+$")
    return (
        F.when(kind == "ip", address).when(kind == "ip6", F.concat(F.lit("20010db8"), F.substring(noise, 1, 24))).when(kind == "email", mail).when(kind == "card", card)
        .when(kind == "phone", F.concat(F.substring(whole, 1, 1), F.substring(shaped, F.lit(2), F.length(whole))))
        .when(kind == "key", F.concat(F.substring(whole, 1, 4), F.substring(shaped, 5, 16)))
        .when(kind == "account", F.concat(F.substring(whole, 1, 2), F.substring(shaped, F.lit(3), F.length(whole))))
        .when(gender.isin("male", "female") & latin, F.concat(F.substring(shaped, F.lit(1), F.greatest(F.length(whole) - 2, F.lit(3))), ending))
        .otherwise(shaped)
    )


def drawn_apart(entities: DataFrame, key: str) -> DataFrame:
    """(kind, whole, surrogate) of distinct entities, all surrogates of a kind different."""
    drawn = _drawn(F.col("whole"), F.col("kind"), F.col("gender"), F.col("attempt"), key)
    state = materialise(
        entities.select("kind", "whole", "gender", F.lit(0).alias("attempt")).withColumn("surrogate", drawn), "surrogates",
    )
    known = entities.select("kind", F.col("whole").alias("surrogate"))
    for _ in range(ROUNDS):
        # Who keeps a shared surrogate is settled by who had it first, then by name.
        low = state.groupBy("kind", "surrogate").agg(F.count("*").alias("k"), F.min(F.struct("attempt", "whole")).alias("first"))
        real = known.join(state.select("kind", "surrogate").distinct(), ["kind", "surrogate"], "left_semi").withColumn("real", F.lit(True))
        again = low.join(real, ["kind", "surrogate"], "left").filter("k > 1 OR real")
        marked = state.join(again, ["kind", "surrogate"], "left")
        redraw = F.col("real").isNotNull() | (F.col("k").isNotNull() & (F.col("first.whole") != F.col("whole")))
        marked = materialise(marked.select("kind", "whole", "gender", "attempt", "surrogate", redraw.alias("redraw")), "surrogates")
        if marked.filter("redraw").isEmpty():
            break
        attempt = F.when(F.col("redraw"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        state = materialise(
            marked.withColumn("attempt", attempt).withColumn(
                "surrogate", F.when(F.col("redraw"), drawn).otherwise(F.col("surrogate"))
            ).drop("redraw"), "surrogates",
        )
    else:
        raise RuntimeError("surrogates of some kind are used up")
    return state.select("kind", "whole", "surrogate")


def _rendered(entity: Column, kind: Column, parts: Column) -> Column:
    """The surrogate in the form of the mention."""
    one = parts[0]
    digits = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike(r"^\d$"), F.substring(one, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        (s["i"] + c.rlike(r"^\d$").cast("int")).alias("i")))["out"]
    spaced = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), lambda s, c: F.struct(
        F.concat(s["out"], F.when(c != " ", F.substring(one, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        (s["i"] + (c != " ").cast("int")).alias("i")))["out"]
    return (
        F.when(kind.isin("phone", "card", "social"), digits).when(kind == "account", spaced)
        .when(kind == "secret", F.concat(F.regexp_extract(entity, _SECRET_HEAD, 0), one, F.regexp_extract(entity, _SECRET_TAIL, 0)))
        .when(kind.isin("email", "ip", "key"), one)
        .when(kind == "ip6", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(one, 4 * k + 1, F.lit(4))), ":"))
        .otherwise(F.concat(F.regexp_extract(entity, _TITLE, 0), F.array_join(parts, " ")))
    )


def replaced(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with `__text`, entities replaced, and `__entities`, how many."""
    own = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"))
    met = materialise(
        mentions(own, "text").filter(F.size("__found") > 0).select("id", "hash", F.col("__found").alias("found"))
        .dropDuplicates(["id", "hash"]), "mentions",
    )
    distinct = materialise(met.select(F.explode("found").alias("entity")).distinct(), "entities")
    parts = materialise(_parts(distinct), "parts")
    women, men = [F.sum((F.col("gender") == g).cast("int")) for g in ("female", "male")]
    denoted = parts.groupBy("kind", "whole").agg(
        F.when(women > men, "female").when(men > women, "male").otherwise("").alias("gender")
    )
    drawn = drawn_apart(denoted, key)
    kind = F.element_at("p", -1)["kind"]
    table = (
        parts.join(drawn, ["kind", "whole"]).groupBy("entity")
        .agg(F.sort_array(F.collect_list(F.struct("part", "surrogate", "kind", "whole"))).alias("p"))
        .select(
            "entity", _rendered(F.col("entity"), kind, F.transform("p", lambda x: x["surrogate"])).alias("new"),
            F.when(kind == "name", F.transform("p", lambda x: F.struct(x["whole"], x["surrogate"]))).alias("names"),
        )
    )
    table = materialise(table, "table")
    listed = F.sort_array(F.collect_list(F.struct("at", "new")))
    placed = met.select("id", "hash", F.posexplode("found").alias("at", "entity")).join(table, "entity").groupBy("id", "hash").agg(
        F.transform(listed, lambda x: x["new"]).alias("__new"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("__names"),
    ).withColumnsRenamed({"id": "__i", "hash": "__h"})
    keyed = docs.withColumns({"__id": F.col(id_column), "__hash": F.xxhash64(text_column)})
    joined = keyed.join(placed, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    between = F.split(F.when(F.col("__new").isNotNull(), F.col(text_column)), PATTERN, -1)
    # Words of the names found in a document are replaced wherever they stand in it.
    joined = joined.withColumn("__known", F.when(F.size("__names") > 0, F.map_from_entries("__names")))
    known = F.col("__known")

    def tokens(gap: Column) -> Column:
        return F.regexp_extract_all(gap, F.lit(_TOKENS), F.lit(0))

    def renamed(gap: Column) -> Column:
        return F.array_join(F.transform(tokens(gap), lambda t: F.coalesce(F.try_element_at(known, t), t)), "")

    bare = F.when(known.isNotNull(), F.aggregate(
        between, F.lit(0), lambda n, g: n + F.size(F.filter(tokens(g), lambda t: F.map_contains_key(known, t)))
    )).otherwise(0)
    woven = F.array_join(F.zip_with(between, "__new", lambda g, n: F.concat(
        F.when(known.isNull(), g).otherwise(renamed(g)), F.coalesce(n, F.lit(""))
    )), "")
    return joined.withColumns({
        "__text": F.coalesce(woven, F.col(text_column)), "__entities": F.coalesce(F.size("__new"), F.lit(0)) + bare,
    }).select(*docs.columns, "__text", "__entities")
