"""Personal data: patterns propose spans, checksums confirm them, and words nearby adjust the score.

Four base kinds stand as found. The method adds account numbers (IBAN, mod 97), social security numbers, access tokens,
keys of known forms, and card numbers within longer runs of digits, as before a check number or a date, when their score
with the words around them reaches ``LEAST_SCORE``. Card numbers within a run are taken at each group of digits that could
begin one, so of two that overlap both are given. Each row is judged by itself; nothing is shuffled.

Positions of matches come from the text between them: splitting by a pattern and extracting it give pieces and matches in
turn. The patterns below find the same spans as their plain forms, but never look at a character again and again: where
the plain form could start anywhere in a run of characters, these start at its head or where the last match ended.

Defined results: a null text is empty and has no spans; repeated rows are judged one by one; no rows give no rows; other
columns of the input play no part. Texts have no length limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of results.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret", "key", "inner_card")
KINDS = BASE + ADDED
# Groups of digits on cards, by the first digits of their issuers.
CARD_FORM = r"[3-6][0-9]{3}(?:[\x20-][0-9]{4}){3}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}|[3-6][0-9]{12,18}"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
    "key": r"(?<![A-Za-z0-9_-])(?:gh[opsru]_[A-Za-z0-9]{36,}+|AKIA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}+"
           r"|eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)(?![A-Za-z0-9_-])",
    "inner_card": rf"(?<![0-9])(?=({CARD_FORM})(?![0-9]))(?:(?<=[0-9][\x20-])|(?=\1[\x20-][0-9]))",
}
# Kinds whose pattern matches a place, at which its first group says what stands there.
PLACES = ("inner_card",)
# A text without any of these characters or pairs has no span of the kind.
NEEDS = {"email": "@", "phone": "+"}
# Matches whose places are added up at once.
BLOCK = 256
SPANS = "array<struct<start:int,end:int,score:double,match:string>>"
# Scores before and after checks, and words that adjust them.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "secret": 0.3, "key": 0.9,
         "inner_card": 0.6}
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|mastercard|payment|credit",
    "phone": r"phone|tel|call|fax|mobile",
    "iban": r"iban|account|konto|compte|cuenta",
    "ssn": r"ssn|social security|tax id",
    "key": r"token|secret|key",
    "inner_card": r"card|visa|mastercard|payment|credit",
    "secret": r"token|secret|api[ _-]?key|apikey|passw|bearer|credential",
}
AGAINST = r"isbn|issn|order no|invoice|part number|sha1|sha256|checksum|commit"
NEAR = 40
CONTEXT_BONUS, CONTEXT_MALUS = 0.4, 0.4
LEAST_SCORE = 0.6


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit confirms the others: from the right, every second digit is doubled, less 9 above 9."""
    figures = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(
        d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod_97(code: Column) -> Column:
    """Whether an account number, its first four characters put last and letters read as 10 to 35, leaves 1 by 97."""
    packed = F.upper(F.regexp_replace(code, r"\x20", ""))
    turned = F.filter(F.split(F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4)), ""), lambda c: c != "")
    value = F.transform(turned, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(value, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))
    return rest == 1


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        digits = digits_of(match)
        return F.char_length(digits).between(12, 19) & luhn(digits)
    if kind == "inner_card":
        return luhn(digits_of(match))
    if kind == "phone":
        return F.char_length(digits_of(match)).between(9, 15)
    if kind == "iban":
        return F.char_length(F.regexp_replace(match, r"\x20", "")).between(15, 34) & mod_97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & ~match.rlike("^[0-9-]+$")
    return F.lit(True)


def _scored(kind: str, before: Column, after: Column) -> Column:
    """The kind's score, raised by words that tell of it and lowered by words that tell of another thing."""
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit("\n"), F.left(after, F.lit(NEAR))))
    return F.lit(SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0) - F.when(
        near.rlike(AGAINST), CONTEXT_MALUS).otherwise(0.0)


def _context(found: Column, gaps: Column, i: Column) -> tuple[Column, Column]:
    """At least ``NEAR`` characters before and after a match where the text has them. Each match has a character at least,
    so no more than ``NEAR`` matches on either side are looked at; between two places there are characters too."""
    first = F.greatest(i - NEAR, F.lit(0))
    before = F.zip_with(
        F.slice(gaps, first + 1, i - first), F.slice(found, first + 1, i - first),
        lambda gap, match: F.right(F.concat(gap, match), F.lit(NEAR)))
    after = F.zip_with(
        F.slice(found, i + 2, F.lit(NEAR)), F.slice(gaps, i + 3, F.lit(NEAR)),
        lambda match, gap: F.left(F.concat(match, gap), F.lit(NEAR)))
    return F.concat(F.array_join(before, ""), F.get(gaps, i)), F.concat(F.get(gaps, i + 1), F.array_join(after, ""))


def _with_spans(frame: DataFrame, kind: str) -> DataFrame:
    """Add the column ``_<kind>``: structs of ``start``, ``end``, ``score`` and ``match``, by start."""
    pattern, kept = PATTERNS[kind], frame.columns
    needed = F.col("text").contains(NEEDS[kind]) if kind in NEEDS else F.col("text").rlike("[0-9]")
    place = kind in PLACES
    frame = frame.withColumn("_found", F.when(needed, F.regexp_extract_all("text", F.lit(pattern), F.lit(int(place)))))
    # A place at the very head would not split a text, so each text begins with a blank more there.
    text = F.concat(F.lit(" "), "text") if place else F.col("text")
    frame = frame.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)))

    def around(match, i):
        if not place:
            return _context(F.col("_found"), F.col("_gaps"), i)
        # The gap after a place begins with its match.
        before, after = _context(F.transform("_found", lambda _: F.lit("")), F.col("_gaps"), i)
        return before, F.substr(after, F.char_length(match) + 1)

    def piece(match, i):
        gap = F.get("_gaps", i)
        score = F.when(_confirmed(kind, match), _scored(kind, *around(match, i)))
        if kind in ADDED:
            score = F.when(score >= LEAST_SCORE, score)
        before = F.char_length(gap) - F.when(i == 0, 1).otherwise(0) if place else F.char_length(gap)
        return F.struct(
            before.alias("gap"), F.char_length(match).alias("own"), score.alias("score"), match.alias("match"))

    def step(acc, piece):
        start = acc["at"] + piece["gap"]
        span = F.struct(
            start.alias("start"), (start + piece["own"]).alias("end"), piece["score"].alias("score"),
            piece["match"].alias("match"))
        spans = F.when(piece["score"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        # A place has no length of its own: what stands there is counted with the gap after it.
        return F.struct((start if place else start + piece["own"]).alias("at"), spans.alias("spans"))

    # An array that grows by one is copied each time, so matches are taken in blocks, whose lengths are then added up.
    begun = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    frame = frame.withColumn("_pieces", F.when(F.size("_gaps") > 0, F.transform("_found", piece)))
    last = F.floor((F.size("_pieces") - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda block: F.aggregate(
        F.slice("_pieces", block * BLOCK + 1, BLOCK), begun, step))
    frame = frame.withColumn("_blocks", F.when(F.size("_pieces") > 0, blocks))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ahead"))
    ahead = F.aggregate("_blocks", none, lambda acc, block: F.struct(
        (acc["at"] + block["at"]).alias("at"), F.concat(acc["ahead"], F.array(acc["at"])).alias("ahead")), lambda acc: acc["ahead"])
    frame = frame.withColumn("_ahead", ahead)

    def placed(block, i):
        return F.transform(block["spans"], lambda span: F.struct(
            (span["start"] + F.get("_ahead", i)).alias("start"), (span["end"] + F.get("_ahead", i)).alias("end"),
            span["score"].alias("score"), span["match"].alias("match")))

    spans = F.coalesce(F.flatten(F.transform("_blocks", placed)), F.array().cast(SPANS))
    return frame.withColumn(f"_{kind}", spans).select(*kept, f"_{kind}")


def find(docs: DataFrame) -> DataFrame:
    """``(row, text, n_<kind>, spans)``: ``row`` holds the columns of the input, ``spans`` are structs of ``start``,
    ``place`` of the kind in ``KINDS``, ``end``, ``kind``, ``score`` and ``match``, by start and kind."""
    step = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        step = _with_spans(step, kind)

    def named(place, kind):
        return F.transform(f"_{kind}", lambda span: F.struct(
            span["start"].alias("start"), F.lit(place).alias("place"), span["end"].alias("end"),
            F.lit(kind).alias("kind"), span["score"].alias("score"), span["match"].alias("match")))

    every = F.sort_array(F.concat(*[named(place, kind) for place, kind in enumerate(KINDS)]))
    return step.select(
        "row", "text", *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS], every.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda span: span["place"] < len(BASE))
    return find(docs.select("doc_id", "text")).select(
        "row.doc_id", *[f"n_{kind}" for kind in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``(row, text)``: the text with each span's kind in its place; of spans that overlap the first stands."""
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, span):
        gap = F.substr(F.col("text"), acc["at"] + 1, span["start"] - acc["at"])
        tag = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.when(span["start"] < acc["at"], acc).otherwise(F.struct(
            span["end"].alias("at"), F.concat(acc["parts"], F.array(gap, tag)).alias("parts")))

    text = F.aggregate("spans", begun, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substr(F.col("text"), acc["at"] + 1)))
    return find(docs).select("row", text.alias("text"))
