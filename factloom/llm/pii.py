"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.  Built-in functions only.

A kind's matches are found with `regexp_extract_all` and the text between them with `split` by the same pattern; running sums of
their lengths give the positions, in code points.  The patterns of the base kinds match exactly what their plain forms (in the
comments) match leftmost without overlap; possessive repeats and run-start conditions only spare the matcher from trying again
what must fail, so its time stays linear in the text, and from recursing on long runs.

An IBAN may be followed by a word or number that could belong to it, or stand after one that looks like a beginning.  So its
pattern consumes one letter and looks ahead at the longest candidate that ends with a word (15 to 34 characters without spaces);
of the candidate's beginnings that end with a word and that mod 97 confirms, the one of the country's length is the span, else the longest;
leftmost without overlap.

Kinds: email, ip, card and phone as validated base kinds, and the added kinds iban (ISO 13616, mod 97) and ssn (United States; no
check digit).  A span has a score: its kind's prior (an IBAN that has not its country's length gets less), plus CONTEXT where one of the
kind's words stands within the NEAR characters before it, as far as the kind's last match.  The score decides on added kinds, which are spans from ACCEPT on: an
IBAN of its country's length is one anywhere, any other IBAN and an ssn only near their words.  Base kinds are spans at any score.

Edge cases: null text counts as empty (no spans); detection and masking take linear time in long texts and many spans (positions are
found through pieces of PIECE characters, never from the text's beginning); spans of different kinds may overlap, masking joins
them; repeated rows get repeated results; an empty table gives an empty result; other columns pass through (`detect` adds only the column it is asked to).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
CONTEXT = 0.25
#: Least score of a span of an added kind.
ACCEPT = 0.6
#: Elements of an array that are added up, and characters of a text that are counted, at once.
CHUNK = 256
PIECE = 1024
# Lengths of the countries' IBANs, as registered.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this has no match of the pattern (and is not searched any further).
    hint: str
    words: str
    prior: float
    #: What the prior loses where the country's length is missed.
    odd: float = 0.0


BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|kontakt|correo|courriel", 0.7),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"\bip\b|address|server|host|adresse", 0.5),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]{4}|[0-9][ -][0-9]", "card|visa|master|credit|karte|carte|tarjeta", 0.6),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|call|\btel\b|mobile|telefon|teléfono", 0.6),
    # a candidate in group 1: [A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30} between other characters than letters and digits
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]", "[A-Z]{2}[0-9]{2}[ A-Z0-9]", r"iban|account|konto|compte|cuenta", 0.7, 0.25),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\bssn\b|social security|social insurance", 0.4),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


NO_INT = "cast(array() as array<int>)"


def running(values: Column, both: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Sum (or what `both` makes of two) of all elements up to and with each; in chunks, so that the time is not quadratic."""

    def within(x: Column) -> Column:
        return F.aggregate(x, F.expr(NO_INT), lambda acc, n: F.concat(acc, F.array(F.coalesce(both(F.try_element_at(acc, F.lit(-1)), n), n))))

    def raised(chunks: Column) -> Column:
        zero = F.struct(F.lit(None).cast("int").alias("last"), F.expr(NO_INT).alias("before"))
        before = F.aggregate(chunks, zero, lambda acc, c: F.struct(F.coalesce(both(acc["last"], F.element_at(c, -1)), F.element_at(c, -1)).alias("last"), F.concat(acc["before"], F.array(acc["last"])).alias("before")))["before"]
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c, lambda x: F.coalesce(both(b, x), x))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: within(F.slice(values, c * CHUNK + 1, F.lit(CHUNK))))
    return F.when(F.size(values) <= CHUNK, within(values)).otherwise(raised(chunks))


def pieces(text: Column) -> Column:
    """A text as an array of its PIECE characters at a time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces_: Column, start: Column, end: Column) -> Column:
    """The characters from start to before end of a text in pieces: reads no others but those of the first and last piece."""
    first = F.floor(start / PIECE).cast("int")
    some = F.array_join(F.slice(pieces_, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """An IBAN's remainder: its first four characters go last, letters count as 10 to 35."""
    bare = F.regexp_replace(match, " ", "")
    order = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.regexp_extract_all(order, F.lit("."), F.lit(0)), F.lit(0), step)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & (mod97(match) == 1)
    return F.lit(True)


def _iban_in(candidate: Column) -> Column:
    """(m, exact) of a candidate: its valid beginning that ends with a word and has the country's length, else the longest; m is null if none is valid."""
    words = F.split(candidate, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    good = F.filter(heads, lambda x: valid("iban", x))
    lengths = F.create_map(*(F.lit(x) for pair in LENGTHS.items() for x in pair))
    exact = F.try_element_at(F.filter(good, lambda x: F.length(F.regexp_replace(x, " ", "")) == F.try_element_at(lengths, F.substring(candidate, 1, 2))), F.lit(1))
    return F.struct(F.coalesce(exact, F.try_element_at(good, F.lit(-1))).alias("m"), exact.isNotNull().alias("exact"))


def _iban_spans(k: Kind, rank: int, pieces_: Column, candidates: Column, ends: Column) -> Column:
    """The spans of all candidates (ends: of the one letter that each of them consumed), leftmost without overlap."""
    found = F.transform(F.arrays_zip(candidates.alias("c"), ends.alias("e")), lambda x: F.struct((x["e"] - 1).alias("start"), _iban_in(x["c"]).alias("i")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,score:double>>)")

    def kept(acc: Column, x: Column) -> Column:
        near_from = F.greatest(acc["since"], x["start"] - NEAR)
        near = F.lower(part(pieces_, near_from, x["start"])).rlike(k.words)
        score = F.when(x["i"]["exact"], k.prior).otherwise(k.prior - k.odd) + F.when(near, CONTEXT).otherwise(0.0)
        own = F.struct(x["start"].alias("start"), (x["start"] + F.length(x["i"]["m"])).alias("end"), score.alias("score"))
        # spans are gathered by the chunk, so that adding one does not copy all
        full = F.size(acc["some"]) >= CHUNK
        more = F.struct(own["end"].alias("since"), F.when(full, F.array(own)).otherwise(F.concat(acc["some"], F.array(own))).alias("some"), F.when(full, F.concat(acc["all"], F.array(acc["some"]))).otherwise(acc["all"]).alias("all"))
        return F.when((x["start"] >= acc["since"]) & (score >= ACCEPT), more).otherwise(acc)

    zero = F.struct(F.lit(0).alias("since"), none.alias("some"), F.expr("cast(array() as array<array<struct<start:int,end:int,score:double>>>)").alias("all"))
    out = F.aggregate(F.filter(found, lambda x: x["i"]["m"].isNotNull()), zero, kept, lambda acc: F.concat(F.flatten(acc["all"]), acc["some"]))
    return F.transform(out, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(k.name).alias("kind"), x["score"].alias("score")))


def _span_of(k: Kind, rank: int) -> Callable[[Column], Column]:
    """The span of a match (m: match, g: the text since the match before, e: end), or null if it is not valid or not accepted."""

    def span(x: Column) -> Column:
        near = F.lower(F.right(x["g"], F.lit(NEAR))).rlike(k.words)
        found = F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(k.name).alias("kind"), F.when(near, k.prior + CONTEXT).otherwise(k.prior).alias("score"))
        accepted = F.lit(True) if k.name in BASE or k.prior >= ACCEPT else near
        return F.when(valid(k.name, x["m"]) & accepted, found)

    return span


def once(value: Column) -> Column:
    """The value by way of a generator: filters on it are not pushed below, where they would compute it again."""
    return F.explode(F.array(value))


def _found(df: DataFrame, text_col: str) -> DataFrame:
    """(_row, _spans): the row as a struct, so that no working column can clash with one of its own."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    text = F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    found = rows
    for k in KINDS:  # each step is a projection of its own, so that no regular expression is evaluated twice
        hint = F.contains(text, F.lit(k.hint)) if k.hint == "@" else text.rlike(k.hint)
        found = found.withColumn(f"_m_{k.name}", F.when(hint, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none))
    candidates = {k.name: F.when(F.size(f"_m_{k.name}") > 0, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(1))).otherwise(none) for k in KINDS if k.name == "iban"}
    found = found.withColumns({f"_g_{k.name}": F.when(F.size(f"_m_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none) for k in KINDS} | {f"_c_{name}": c for name, c in candidates.items()})
    found = found.withColumn("_pieces", F.when(F.size("_c_iban") > 0, pieces(text)).otherwise(none))
    ends = {f"_e_{k.name}": F.when(F.size(f"_m_{k.name}") > 0, running(F.zip_with(f"_m_{k.name}", F.slice(f"_g_{k.name}", F.lit(1), F.size(f"_m_{k.name}")), lambda m, g: F.length(m) + F.length(g)))).otherwise(F.expr(NO_INT)) for k in KINDS}
    found = found.withColumns(ends)
    each = []
    for rank, k in enumerate(KINDS):
        if k.name in candidates:
            each.append(_iban_spans(k, rank, F.col("_pieces"), F.col(f"_c_{k.name}"), F.col(f"_e_{k.name}")))
            continue
        matches = F.arrays_zip(F.col(f"_m_{k.name}").alias("m"), F.slice(f"_g_{k.name}", F.lit(1), F.size(f"_m_{k.name}")).alias("g"), F.col(f"_e_{k.name}").alias("e"))
        each.append(F.filter(F.transform(matches, _span_of(k, rank)), lambda x: x.isNotNull()))
    spans = F.transform(F.array_sort(F.concat(*each)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return found.select("_row", once(spans).alias("_spans"))


def detect(df: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Adds (or replaces) the array of spans (kind, start, end, score), in order of start, then kind as listed; end is exclusive."""
    return _found(df, text_col).select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != out_col), F.col("_spans").alias(out_col))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scores(spans: Column) -> Column:
    """The spans' scores, joined like the spans."""
    return F.array_join(F.transform(spans, lambda x: F.round(x["score"], 2).cast("string")), ",")


def _merged(spans: Column, reach: Column) -> Column:
    """Spans in order, overlapping ones joined under the kind of the first; `reach`: the greatest end up to and with each."""
    heads = F.filter(F.sequence(F.lit(1), F.size(spans)), lambda i: (i == 1) | (F.element_at(spans, i)["start"] >= F.element_at(reach, F.greatest(F.lit(1), i - 1))))
    lasts = F.concat(F.transform(F.slice(heads, F.lit(2), F.size(heads)), lambda i: i - 1), F.array(F.size(spans)))
    return F.zip_with(heads, lasts, lambda a, b: F.struct(F.element_at(spans, a)["kind"].alias("kind"), F.element_at(spans, a)["start"].alias("start"), F.element_at(reach, b).alias("end")))


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with each span (overlapping ones joined) replaced by its first kind in capitals, as <EMAIL>."""
    text = F.col(f"_row.`{text_col}`")
    found = _found(df, text_col).withColumn("_reach", running(F.transform("_spans", lambda x: x["end"]), lambda a, b: F.when(a > b, a).otherwise(b)))
    some = F.size("_spans") > 0
    found = found.withColumns({"_joined": F.when(some, _merged(F.col("_spans"), F.col("_reach"))), "_pieces": F.when(some, pieces(text))})
    froms = F.concat(F.array(F.lit(0)), F.transform("_joined", lambda x: x["end"]))
    tos = F.concat(F.transform("_joined", lambda x: x["start"]), F.array(F.length(text)))
    marks = F.concat(F.transform("_joined", lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))), F.array(F.lit("")))
    parts = F.transform(F.arrays_zip(froms.alias("a"), tos.alias("b"), marks.alias("m")), lambda x: F.concat(part(F.col("_pieces"), x["a"], x["b"]), x["m"]))
    masked = F.when(some, F.array_join(parts, "")).otherwise(text)
    found = found.select("_row", once(masked).alias("_masked"))
    return found.select(*((F.col("_masked") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in df.columns))
