"""Personal data by patterns, checksums and context, in built-in functions only.

Patterns propose spans, leftmost and without overlap for each kind; validators confirm them: Luhn for cards, mod 97 for
IBANs, ranges of parts and numbers of digits for addresses and phones. What fails is dropped without another try. Whole words
near a span, between it and its neighbours of the same kind, raise or lower its score; all spans are reported with their scores, and redact()
masks those that score LEAST at least, so that `version 1.2.3.4` stays. Positions count code points, ends are exclusive.

The patterns equal these plain ones, rewritten so that no text takes more than linear time or deep recursion:
email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, ip [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+),
card [0-9]([\\x20-]?[0-9])+ with 16 to 19 digits, phone \\+[0-9][\\x20().0-9-]+[0-9] with 8 to 15 digits.
A run of characters that cannot be a match's start is entered only at its front or where the last match ended.
IBANs are added to these four kinds; their length follows from the country. Places in long arrays come from sums of STRIDE elements at a time,
and a text is cut in blocks before pieces are taken from it, so work follows a text's length and its number of matches.

Edge cases: a null text has no span (and stays null when redacted); overlapping spans of different kinds are all reported and
redacted as one; repeated rows and ids are treated row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before and after a span in which context words count; least score that is masked.
WINDOW, LEAST = 40, 0.4
STRIDE, _BLOCK = 64, 4096

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    sign: str = ""  # a text without it has no match
    more: tuple[str, ...] = field(default=())
    less: tuple[str, ...] = field(default=())


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "@", ("mail", "mails", "email", "contact", "write", "correo", "courriel")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ".", ("ip", "address", "host", "server", "login"), ("version", "release", "section", "chapter")),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", 0.8, "", ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), ("isbn", "order", "serial", "tracking")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "+", ("phone", "telephone", "telefon", "call", "tel", "mobile", "fax", "whatsapp")),
    Kind("iban", rf"(?<![A-Za-z0-9]){IBAN}(?![A-Za-z0-9])", 0.8, "", ("iban", "account", "bank", "konto", "compte", "cuenta")),
)
BASE = ("email", "ip", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """Whether the first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(moved, F.lit(0), step) == 1)


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return _mod97(x) if kind == "iban" else F.lit(True)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is made once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(xs: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of the array `xs`, which must be cheap to name, op over all before it, by strides."""
    whole = lambda i: F.floor(i / STRIDE).cast("int")
    totals = F.transform(F.sequence(F.lit(0), whole(F.size(xs))), lambda c: F.aggregate(F.slice(xs, c * STRIDE + 1, F.lit(STRIDE)), zero, op))
    start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
    before = F.aggregate(totals, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    return _once(before, lambda b: F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, whole(i) * STRIDE + 1, i % STRIDE), F.get(b, whole(i)), op)))


def _near(around: Column, words: tuple[str, ...]) -> Column:
    return around.rlike("(?:^|[^a-z])(?:" + "|".join(words) + ")(?:[^a-z]|$)") if words else F.lit(False)


def find(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind's confirmed spans, in order."""
    span = "array<struct<kind:string,start:int,end:int,score:double>>"
    parts = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"), F.split(text, kind.pattern, -1).alias("between"))

    def spans(p: Column) -> Column:
        size = F.zip_with(p["match"], F.slice(p["between"], F.lit(1), F.size(p["match"])), lambda m, b: F.length(m) + F.length(b))

        def one(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(p["between"], i))
            around = F.lower(F.concat_ws(" ", F.right(F.get(p["between"], i), F.lit(WINDOW)), F.left(F.get(p["between"], i + 1), F.lit(WINDOW))))
            score = F.lit(kind.score) + F.when(_near(around, kind.more), 0.1).otherwise(0.0) - F.when(_near(around, kind.less), 0.3).otherwise(0.0)
            found = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"))
            return F.when(valid(kind.name, m), found)

        every = _once(size, lambda n: _once(_running(n, F.lit(0), lambda a, x: a + x), lambda before: F.transform(p["match"], lambda m, i: one(m, i, before))))
        return F.filter(every, lambda x: x.isNotNull())

    present = text.rlike(kind.pattern)
    if kind.sign:
        present = F.contains(text, F.lit(kind.sign)) & present
    return F.when(present, _once(parts, spans)).otherwise(F.array().cast(span))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with a struct column `into`: an array of spans for each kind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(into, F.struct(*[find(body, k).alias(k.name) for k in KINDS]))


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, n_iban) for each row."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    every = F.concat(*[F.col(f"spans.{k.name}") for k in KINDS])
    return rows.select(
        "doc_id",
        *[F.size(f"spans.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.concat(*[F.col(f"spans.{k}") for k in BASE])), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
        F.size("spans.iban").cast("long").alias("n_iban"),
    )


def redacted(text: Column, spans: Column, least: float = LEAST) -> Column:
    """The text with [KIND] in place of every span that scores at least `least`; spans that overlap become one mark, that of the first."""
    order = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def marked(s: Column, reach: Column, blocks: Column) -> Column:
        def piece(low: Column, high: Column) -> Column:
            near = F.array_join(F.slice(blocks, block(low) + 1, block(high - 1) - block(low) + 1), "")
            return F.when(high > low, F.substr(near, low % _BLOCK + 1, high - low)).otherwise("")

        heads = F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.get(reach, i).alias("from"))), lambda h: h["start"] >= h["from"])
        out = F.transform(heads, lambda h: F.concat(piece(h["from"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(out, ""), piece(last, F.length(text)))

    def whole(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        reach = _once(ends, lambda e: _running(e, F.lit(0), lambda a, x: F.greatest(a, x)))  # where the spans before end
        return _once(reach, lambda r: _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), lambda b: marked(s, r, b)))

    return F.when(F.size(spans) > 0, _once(order, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(text))).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", least: float = LEAST) -> DataFrame:
    """docs with personal data replaced in `text`, and `n_chars` counted anew where the text is not null; same columns, same rows."""
    spans = "__pii_spans"
    rows = with_spans(docs, text, spans)
    every = F.concat(*[F.col(f"{spans}.{k.name}") for k in KINDS])
    rows = rows.withColumn(text, redacted(F.col(text), every, least))
    if n_chars in docs.columns:
        rows = rows.withColumn(n_chars, F.coalesce(F.length(text).cast("long"), F.col(n_chars)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
