"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Mail addresses, phone numbers, IP addresses, card numbers, secrets and names after a title
are found by patterns. What stands for an entity is a function of a key, its type and its
canonical form (digits only, lower case), so that an entity has one surrogate everywhere;
the surrogate is then written in the format of each mention. Formats hold: digits stay digits,
letters letters of their case, phone numbers keep their first digit, cards their first digit and
a valid check digit, IP addresses valid octets, access keys their prefix. Names get
names of the same gender (by title) and script (Latin, Greek or Cyrillic), part by part, so that
a surname alone and with a first name agree.

Surrogates are checked: two entities of a type never share one, and none equals an entity
that occurs. What collides draws again, until nothing does.

Only texts that may have entities are taken apart and joined, by the hash of the text, so rows need
no id; all others are passed on without a shuffle.
Null, empty and clean texts pass through unchanged; copies get equal texts; texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.session import durable

#: Titles by gender (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]
_TITLES = "|".join(sorted(MALE + FEMALE, key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Patterns; where several fit at a place, the first wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "secret": (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
               r"|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"
               r"|(?<=(?:token|password|passwd|pwd|secret|api_key|apikey) {0,2}[=:] {0,2}[\"']?)"
               r"[A-Za-z0-9/+_.~-]{6,}"
               r"|(?<=(?:Token|Password|Secret|TOKEN|PASSWORD|SECRET|API_KEY) {0,2}[=:] {0,2}[\"']?)"
               r"[A-Za-z0-9/+_.~-]{6,}"),
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": (r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
              r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
              r"|(?<![0-9A-Za-z.+-])[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
COMBINED = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no entity, since each pattern needs one of them; far cheaper than the patterns.
HINT = r"[@0-9=:]|AKIA|[0-9A-Fa-f]{32}|" + _TITLES

#: Syllables of surrogate names by script, endings by gender (fixed values).
SYLLABLES = {
    "latin": "ba be da de fa ga jo ka la le ma mi na no ra ri sa si ta to va vi za zo".split(),
    "cyrillic": "ба бе да де фа га жо ка ла ле ма ми на но ра ри са си та то ва ви за зо".split(),
    "greek": "βα βε δα δε φα γα ζο κα λα λε μα μι να νο ρα ρι σα σι τα το βα βι ζα ζο".split(),
}
ENDINGS = {"latin": ("n", "na"), "cyrillic": ("н", "на"), "greek": ("ς", "να")}
ROUNDS = 64


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hinted(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(HINT), F.lit(False))


def _kind(value: str) -> str:
    """SQL: the type of a mention."""
    return (
        f"CASE WHEN {value} LIKE '%@%' THEN 'email'"
        f" WHEN {value} rlike {_sql(f'^(?:{_TITLES})[.]? ')} THEN 'name'"
        f" WHEN {value} rlike {_sql(f'^(?:{_OCTET}[.]){{3}}{_OCTET}$')} THEN 'ip'"
        f" WHEN {value} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'"
        f" WHEN {value} rlike '^(?:[(+][0-9() .-]+|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{4}})$'"
        f" THEN 'phone'"
        f" WHEN {value} rlike '^[0-9][0-9 -]{{12,}}$' THEN 'card' ELSE 'secret' END"
    )


def _picked(place: str, of: str) -> str:
    """SQL: a character of ``of`` chosen by byte ``place`` of the digest ``h``."""
    return (f"substr('{of}', CAST(conv(substr(h, 2 * pmod({place}, 64) + 1, 2), 16, 10) AS INT)"
            f" % {len(of)} + 1, 1)")


def _scrambled(value: str, keep: int = 0) -> str:
    """SQL: ``value`` with its letters and digits drawn anew, the first ``keep`` as they are."""
    lower, upper, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return (
        f"array_join(transform(split({value}, ''), (c, i) -> CASE WHEN i < {keep} THEN c"
        f" WHEN c rlike '[0-9]' THEN {_picked('i', number)}"
        f" WHEN c rlike '[a-z]' THEN {_picked('i', lower)}"
        f" WHEN c rlike '[A-Z]' THEN {_picked('i', upper)} ELSE c END), '')"
    )


def _luhn(digits: str) -> str:
    """SQL: the check digit after ``digits``."""
    total = (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 1 THEN CAST(c AS INT)"
        f" WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END), 0, (a, x) -> a + x)"
    )
    return f"CAST(pmod(10 - {total} % 10, 10) AS STRING)"


def _syllables(script: str, start: int, n: int) -> str:
    array = "array(" + ", ".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
    parts = [f"element_at({array}, CAST(conv(substr(h, {2 * k + 1}, 2), 16, 10) AS INT) % {len(SYLLABLES[script])} + 1)"
             for k in range(start, start + n)]
    return f"concat({', '.join(parts)})"


def _surrogate(longer: int) -> str:
    """SQL: the surrogate of ``canon`` of type ``kind`` from the digest ``h``; names ``longer`` by syllables."""
    hexes = (f"array_join(transform(split(canon, ''), (c, i) -> {_picked('i', '0123456789abcdef')}), '')")
    octets = ", ".join(
        f"CAST(CAST(conv(substr(h, {4 * k + 1}, 4), 16, 10) AS INT) % {254 if k in (0, 3) else 256}"
        f" + {1 if k in (0, 3) else 0} AS STRING)" for k in range(4))
    card = _scrambled("substr(canon, 1, length(canon) - 1)", 1)
    names = []
    for script in SYLLABLES:
        man, woman = ENDINGS[script]
        names.append(
            f"WHEN kind = 'given {script} m' THEN initcap(concat({_syllables(script, 0, 3 + longer)}, '{man}'))"
            f" WHEN kind = 'given {script} f' THEN initcap(concat({_syllables(script, 0, 3 + longer)}, '{woman}'))"
            f" WHEN kind = 'family {script}' THEN initcap({_syllables(script, 0, 4 + longer)})")
    domain = "concat(" + _scrambled("regexp_extract(canon, '^[^@]*@(.*)[.][a-z]+$', 1)").replace(
        "substr(h,", "substr(hd,") + ", regexp_extract(canon, '([.][a-z]+)$', 1))"
    return (
        "CASE WHEN kind = 'email' THEN concat("
        + _scrambled("regexp_extract(canon, '^([^@]*)@', 1)") + f", '@', {domain})"
        f" WHEN kind = 'ip' THEN concat_ws('.', {octets})"
        f" WHEN kind = 'card' THEN concat({card}, {_luhn(card)})"
        f" WHEN kind = 'phone' THEN {_scrambled('canon', 1)}"
        f" WHEN kind = 'ssn' THEN {_scrambled('canon')}"
        f" WHEN kind = 'secret' AND canon rlike '^AKIA' THEN {_scrambled('canon', 4)}"
        f" WHEN kind = 'secret' AND canon rlike '^[0-9a-f]+$' THEN {hexes}"
        f" WHEN kind = 'secret' AND canon rlike '^[0-9A-F]{{32,}}$' THEN upper({hexes})"
        f" {' '.join(names)} ELSE {_scrambled('canon')} END"
    )


def _drawn(pending: DataFrame, key: str, attempt: int) -> DataFrame:
    """``pending`` (kind, canon) with a surrogate of this attempt; names grow, so any number gets one."""
    salted = pending.withColumns({
        "h": F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(attempt)), 512),
        "hd": F.sha2(F.concat_ws("|", F.lit(key), F.regexp_extract("canon", "@(.*)$", 1)), 512),
    })
    return salted.select("kind", "canon", F.expr(_surrogate(attempt // 2)).alias("surrogate"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for the distinct ``entities`` (kind, canon), without collisions."""
    known = durable(entities.select("kind", "canon").distinct())
    taken = known.select("kind", F.col("canon").alias("surrogate"))
    pending, done = known, None
    for attempt in range(ROUNDS):
        drawn = _drawn(pending, key, attempt).join(taken, ["kind", "surrogate"], "left_anti")
        best = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        fixed = durable(best.select("kind", "canon", "surrogate"))
        done = fixed if done is None else done.unionByName(fixed)
        pending = durable(pending.join(fixed, ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return done
        taken = taken.unionByName(fixed.select("kind", "surrogate"))
    raise RuntimeError("entities of one format outnumber its surrogates")


def _parts(mentions: DataFrame) -> DataFrame:
    """(value, part, kind, canon): what of a mention has a surrogate of its own."""
    script = ("CASE WHEN value rlike '[Ͱ-Ͽ]{2}' THEN 'greek' WHEN value rlike '[Ѐ-ӿ]{2}' THEN 'cyrillic'"
              " ELSE 'latin' END")
    women = "|".join(FEMALE)
    gender = f"CASE WHEN value rlike '^(?:{women})[. ]' THEN 'f' ELSE 'm' END"
    names = "slice(split(value, ' '), 2, 2)"
    named = (f"transform({names}, (x, i) -> named_struct('kind', CASE WHEN i = size({names}) - 1 THEN"
             f" concat('family ', {script}) ELSE concat('given ', {script}, ' ', {gender}) END, 'canon', x))")
    digits = "array(named_struct('kind', kind, 'canon', regexp_replace(value, '[^0-9]', '')))"
    other = "array(named_struct('kind', kind, 'canon', CASE WHEN kind = 'email' THEN lower(value) ELSE value END))"
    typed = mentions.select("value", F.expr(_kind("value")).alias("kind"))
    parts = (f"CASE WHEN kind = 'name' THEN {named} WHEN kind IN ('phone', 'card', 'ssn') THEN {digits}"
             f" ELSE {other} END")
    return typed.select("value", F.posexplode(F.expr(parts)).alias("part", "e")).select(
        "value", "part", "e.kind", "e.canon")


def _written() -> Column:
    """The surrogates ``s`` of a mention's parts in the format of the mention."""
    at = "length(regexp_replace(substr(value, 1, i + 1), '[^0-9]', ''))"
    digits = (f"array_join(transform(split(value, ''), (c, i) -> CASE WHEN c rlike '[0-9]' THEN"
              f" substr(s[0], {at}, 1) ELSE c END), '')")
    return F.expr(
        "CASE WHEN kind LIKE 'family%' OR kind LIKE 'given%' THEN"
        " concat_ws(' ', split(value, ' ')[0], array_join(s, ' '))"
        f" WHEN kind IN ('phone', 'card', 'ssn') THEN {digits}"
        " WHEN kind = 'email' AND value = upper(value) THEN upper(s[0]) ELSE s[0] END")


def replaced(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text column; ``count`` names a column for their number."""
    found = F.expr(f"regexp_extract_all(text, {_sql(COMBINED)}, 0)")
    # Whole rows travel as one column, whatever their columns are called.
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    hint = hinted("text")
    texts = rows.filter(hint).select(F.md5("text").alias("k"), F.posexplode(found).alias("pos", "value"))
    mentions = durable(texts.distinct())
    parts = durable(_parts(mentions.select("value").distinct()))
    mapped = parts.join(surrogates(parts, key), ["kind", "canon"])
    written = mapped.groupBy("value").agg(
        F.min("kind").alias("kind"),
        F.transform(F.sort_array(F.collect_list(F.struct("part", "surrogate"))), lambda x: x.surrogate).alias("s"))
    written = written.select("value", _written().alias("surrogate"))
    lists = mentions.join(written, "value").groupBy("k").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "surrogate"))), lambda x: x.surrogate).alias("s"))
    pieces = F.expr(f"split(text, {_sql(COMBINED)}, -1)")
    hits = rows.filter(hint).withColumn("k", F.md5("text")).join(lists, "k", "left")
    new = F.when(F.col("s").isNull(), F.col("text")).otherwise(
        F.array_join(F.flatten(F.zip_with(pieces, F.col("s"),
                                          lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))
    kept = {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns}
    out, plain = [*(kept | {text: new.alias(text)}).values()], [*kept.values()]
    if count:
        out.append(F.coalesce(F.size("s"), F.lit(0)).cast("long").alias(count))
        plain.append(F.lit(0).cast("long").alias(count))
    return hits.select(*out).unionByName(rows.filter(~hint).select(*plain))
