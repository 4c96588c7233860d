"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression: no Python runs on the executors.

The four base kinds (email, ip, card, phone) use fixed patterns; a match that
fails its check is dropped and not retried. ``iban`` (mod-97) and ``ssn``
(number ranges, and a context word is needed) are this module's own kinds and
are kept from a score of ``min_score``. Every IBAN opening (two capitals, two
digits, nothing alphanumeric before) is tried on its own: first at the length
its country gives, blanks between groups of four or not, then, if mod-97 fails,
as the longest run of characters or of blank-separated groups. Confirmed IBANs
that overlap all count.

A pattern is applied twice, as ``regexp_extract_all`` (the matches) and as
``split`` (the pieces between them). Their lengths, summed up, are the
offsets. The pieces also hold the context. The patterns are written with
possessive repeats and run-start guards, which match the same spans as the
plain forms but take time linear in the text and no stack, so that unbroken
runs of any length are safe.

Defined cases: a null text counts as empty and has no spans; a null doc_id
stays null; repeated rows give repeated results; columns other than doc_id
and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import pick

CONTEXT_CHARS = 40
CHUNK = 128  # running sums go over chunks of this many matches

# Context words per kind, and words that speak against a kind.
CONTEXT = {
    "email": ("mail", "contact", "write to", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "security number"),
}
AGAINST = {
    "email": ("example",), "ip": ("version", "release", "section"), "card": ("isbn", "serial", "tracking", "order"),
    "phone": ("isbn", "serial"), "iban": ("sha", "hash", "commit"), "ssn": ("isbn", "serial", "part no"),
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str   # what Spark runs
    plain: str     # the same spans without guards, for other engines
    prior: float   # score of a confirmed span without context
    base: bool
    opens: int = 0  # characters a match takes from the text, if it only opens a span and captures what follows


IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
# an opening, and as much text as the longest span and the character after it take
IBAN_OPENING = r"(?=[A-Z]{2}[0-9]{2}\x20?[A-Z0-9])(?<![A-Za-z0-9])(?=([\s\S]{4,48}))[A-Z]{2}[0-9]{2}"
IBAN_ENDS = tuple(rf"^((?>{p}))(?![A-Za-z0-9])" for p in ("|".join(
    rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, codes in IBAN_LENGTHS.items()), IBAN))
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.9, True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.7, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", 0.8, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, True),
    Kind("iban", IBAN_OPENING, IBAN, 0.8, False, 4),
    Kind("ssn", SSN, SSN, 0.3, False),
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_RANGE = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
ADDED_CONTEXT, ADDED_AGAINST = 0.3, -0.3
MIN_SCORE = 0.5


def _running_starts(lengths: Column, start: Column) -> Column:
    return F.aggregate(lengths, F.struct(start.alias("t"), F.array().cast("array<bigint>").alias("a")),
                       lambda s, n: F.struct((s["t"] + n).alias("t"), F.array_append(s["a"], s["t"]).alias("a")),
                       lambda s: s["a"])


def _chunks(lengths: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
                       lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def worth(place, i):
        d = place.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)
    places = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(F.filter(places, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an IBAN without blanks leaves remainder 1."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))

    def step(acc, ch):
        v = F.ascii(ch)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)
    chars = F.filter(F.split(turned, ""), lambda ch: ch != "")
    return F.aggregate(chars, F.lit(0), step) == 1


def _iban(window: Column) -> Column:
    """The confirmed IBAN that a text begins with, or ''."""
    found = F.lit("")
    for ends in reversed(IBAN_ENDS):
        value = F.regexp_extract(window, ends, 1)
        code = F.replace(value, F.lit(" "), F.lit(""))
        found = F.when(F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False), value).otherwise(found)
    return found


def _confirmed(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(IP_RANGE)
    if kind in ("card", "phone"):
        digits = F.regexp_replace(value, "[^0-9]", "")
        low, high = (13, 19) if kind == "card" else (9, 15)
        in_range = F.length(digits).between(low, high)
        return F.when(in_range, luhn(digits)).otherwise(False) if kind == "card" else in_range
    if kind == "iban":
        return value != ""
    bounded = ~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]")
    return bounded & ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("0000$")


def _score(kind: Kind, s: Column) -> Column:
    near = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))

    def says(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | near.contains(w)
        return hit
    score = (F.lit(kind.prior) + F.when(says(CONTEXT[kind.name]), ADDED_CONTEXT).otherwise(0.0)
             + F.when(says(AGAINST[kind.name]), ADDED_AGAINST).otherwise(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _with_spans(df: DataFrame, text: Column, min_score: float) -> DataFrame:
    """``df`` and, under each kind's name, its confirmed spans as array<struct<kind, start, end, score>>, in order of start.

    Each step is a projection of its own: a lambda must not hold an expression
    over the whole text, or it would be computed again for every element.
    """
    keep = [F.col(c) for c in df.columns]
    names = [k.name for k in KINDS]
    col = {f: (lambda k, f=f: F.col(f"{f}_{k}")) for f in ("hits", "pieces", "lengths", "totals", "starts")}

    def each(f, make):
        return [F.when(F.size(col["hits"](k)) > 0, make(k)).alias(f"{f}_{k}") for k in names]
    patterns, opens = {k.name: k.pattern for k in KINDS}, {k.name: k.opens for k in KINDS}
    df = df.select(*keep, *[F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(1 if opens[k] else 0)).alias(f"hits_{k}") for k in names])
    hits = [col["hits"](k) for k in names]
    df = df.select(*keep, *hits, *each("pieces", lambda k: F.split(text, patterns[k], -1)))
    pieces = [col["pieces"](k) for k in names]
    # a piece and the match that ends it
    df = df.select(*keep, *hits, *pieces, *each("lengths", lambda k: F.zip_with(
        F.slice(col["pieces"](k), F.lit(1), F.size(col["hits"](k))), col["hits"](k),
        lambda p, m: (F.length(p) + (F.lit(opens[k]) if opens[k] else F.length(m))).cast("bigint"))))
    # exclusive running sums in two levels, so that the work stays near linear in the matches of one text
    df = df.select(*keep, *hits, *pieces, *each("lengths", lambda k: _chunks(col["lengths"](k))))
    df = df.select(*keep, *hits, *pieces, *[col["lengths"](k) for k in names], *each("totals", lambda k: _running_starts(
        F.transform(col["lengths"](k), lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, n: a + n)),
        F.lit(0).cast("bigint"))))
    df = df.select(*keep, *hits, *pieces, *each("starts", lambda k: F.flatten(
        F.zip_with(col["lengths"](k), col["totals"](k), _running_starts))))
    return df.select(*keep, *[_found(k, col["hits"](k.name), col["pieces"](k.name), col["starts"](k.name),
                                     min_score).alias(k.name) for k in KINDS])


def _found(kind: Kind, hits: Column, pieces: Column, starts: Column, min_score: float) -> Column:
    # left() and right() take the pieces' ends, so that the context costs no scan of the whole text
    before = F.slice(pieces, F.lit(1), F.size(hits))
    after = F.slice(pieces, F.lit(2), F.size(hits))
    values = hits
    if kind.opens:
        values = F.transform(hits, _iban)
        after = F.zip_with(after, values, lambda p, v: F.substr(p, F.greatest(F.length(v) - kind.opens, F.lit(0)) + 1))
    parts = F.arrays_zip(
        values.alias("value"), starts.alias("at"),
        F.transform(before, lambda p: F.right(p, F.lit(CONTEXT_CHARS))).alias("before"),
        F.transform(before, lambda p: F.length(p)).alias("gap"),
        F.transform(after, lambda p: F.left(p, F.lit(CONTEXT_CHARS))).alias("after"))
    kept = F.transform(F.filter(parts, lambda s: _confirmed(kind.name, s)), lambda s: F.struct(
        F.lit(kind.name).alias("kind"), (s["at"] + s["gap"]).alias("start"),
        (s["at"] + s["gap"] + F.length(s["value"])).alias("end"), _score(kind, s).alias("score")))
    if not kind.base:
        kept = F.filter(kept, lambda s: s["score"] >= min_score)
    return F.when(F.size(hits) > 0, kept).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and one array of spans per kind, ordered by start.

    Offsets count code points, end exclusive. Base kinds are kept whatever
    their score; the other kinds from ``min_score``.
    """
    d = pick(docs, "doc_id", "text").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return _with_spans(d, F.col("text"), min_score)


def span_text(kinds) -> Column:
    """``kind:start:end`` of the named span columns, in that order, comma-joined."""
    return F.array_join(F.flatten(F.array(*[
        F.transform(F.col(k), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        for k in kinds])), ",")


def _running_ends(ends: Column, start: Column) -> Column:
    """Before each element the largest so far, ``start`` included."""
    return F.aggregate(ends, F.struct(start.alias("m"), F.array().cast("array<bigint>").alias("a")),
                       lambda s, e: F.struct(F.greatest(s["m"], e).alias("m"), F.array_append(s["a"], s["m"]).alias("a")),
                       lambda s: s["a"])


def _cut(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep``, ``changed`` and ``new_text``: ``text`` with its sorted ``spans`` (start, minus_end, kind) replaced by their kinds.

    A span that starts at or after the end of all before it opens a hole, and
    that end is where the hole before it ended. Running ends and pieces of
    text go over chunks, so the work stays near linear in the spans and the
    text's length.
    """
    zero = F.lit(0).cast("bigint")
    df = df.select(*keep, text.alias("whole"), "spans", F.when(F.size("spans") > 0, _chunks(F.transform("spans", lambda s: -s["minus_end"]))).alias("ends"))
    df = df.select(*keep, "whole", "spans", "ends", _running_ends(F.transform("ends", F.array_max), zero).alias("tops"),
                   F.array_max(F.transform("ends", F.array_max)).alias("last"))
    df = df.select(*keep, "whole", "spans", "last", F.flatten(F.zip_with("ends", "tops", _running_ends)).alias("before"))
    holes = F.filter(F.zip_with("spans", "before", lambda s, e: F.struct(s["start"].alias("s"), e.alias("from"), s["kind"].alias("kind"))),
                     lambda h: h["s"] >= h["from"])
    df = df.select(*keep, "whole", "last", F.when(F.col("last").isNotNull(), _chunks(holes)).alias("holes"))

    def piece(chunk: Column) -> Column:
        start, end = F.get(chunk, F.lit(0))["from"], F.element_at(chunk, -1)["s"]
        return F.struct(chunk.alias("holes"), start.alias("from"), F.substring("whole", (start + 1).cast("int"), (end - start).cast("int")).alias("text"))
    df = df.select(*keep, "whole", "last", F.transform("holes", piece).alias("pieces"))

    def filled(p: Column) -> Column:
        return F.array_join(F.transform(p["holes"], lambda h: F.concat(
            F.substring(p["text"], (h["from"] - p["from"] + 1).cast("int"), (h["s"] - h["from"]).cast("int")), F.lit("["), F.upper(h["kind"]), F.lit("]"))), "")
    tail = F.substring("whole", (F.col("last") + 1).cast("int"), F.length("whole"))
    return df.select(*keep, F.col("last").isNotNull().alias("changed"), F.when(
        F.col("last").isNotNull(), F.concat(F.array_join(F.transform("pieces", filled), ""), tail)).otherwise(F.col("whole")).alias("new_text"))


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, as ``[EMAIL]``.

    Overlapping spans are one hole, named after the span that starts first
    (ties: the longer one). Column names, order and all other columns stay,
    but ``n_chars``, where there is one, becomes the new length. Null texts
    stay null.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index('text')}"
    text = F.coalesce(F.col(at), F.lit(""))
    spanned = _with_spans(flat, text, min_score)
    holes = spanned.select(*flat.columns, F.array_sort(F.flatten(F.array(*[
        F.transform(F.col(k.name), lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))) for k in KINDS]))).alias("spans"))
    out = _cut(holes, F.col(at), [F.col(c) for c in flat.columns])
    back = []
    for i, name in enumerate(names):
        c = F.col(f"c{i}")
        if i == names.index("text"):
            c = F.col("new_text")
        elif name == "n_chars" and i == names.index("n_chars"):
            c = F.when(F.col("changed"), F.length("new_text").cast(flat.schema[i].dataType)).otherwise(c)
        back.append(c.alias(name))
    return out.select(back)
