"""Personal data: patterns propose, checksums confirm, context adjusts (operator 7, DataFrame functions only).

Each kind has a pattern, a check and a base score.  A text is first rewritten character for character, so that the
separators a pattern allows only between two letters or digits become one private character: every pattern is then a
row of single-character loops, which the JVM's regular expressions match in linear time and without recursion.

Splitting a text at a pattern gives the pieces between matches; with the matches they give every span by a running
sum of lengths, taken in runs of ``RUN`` matches so that it costs next to nothing more for a text of many.  Luhn (cards),
mod-97 (IBANs), ranges (addresses) and digit counts (phones) confirm; whole context words in any of five languages within
``WINDOW`` characters before or after a span, and no further than its neighbours of the kind, raise its score.  Kinds with a
low base score are returned only if context lifts them to ``accept``.

Base kinds: email, ip, card, phone.  Added: iban (mod-97), ssn (three-two-four digits beside a context word), secret
(a key, token or password that is given a value).

Edge cases: a null or empty text has no spans; a null doc_id is returned as it is; repeated rows are searched each; very
long texts are searched whole; spans of different kinds may overlap, ties in place come in the order of the kinds; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN = "\ue000"  # stands for a separator between two of the characters it may join
OTHER = "\ue001"  # what a JOIN in the text itself becomes
WINDOW = 40
RUN = 256


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str  # a cheap pattern that every text with a match also matches
    joints: str  # separators to rewrite, '' for none
    pattern: str
    score: float
    words: tuple = ()


WORD = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", "@", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", rf"(?:\G|(?<![{JOIN}{WORD}]))[{JOIN}{WORD}]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]++", 0.9, ("e-?mail", "mail", "contact", "write", "courriel", "correo", "kontakt", "contacto", "schreiben")),
    Kind("ip", r"[0-9]\.[0-9]", "", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, ("ip", "host", "server", "address", "adresse", "serveur", "servidor", "dirección", "indirizzo")),
    Kind("card", r"[0-9][ 0-9-]{14}", r"(?<=[0-9])[ -](?=[0-9])", rf"[0-9][0-9{JOIN}]++", 0.8, ("card", "visa", "credit", "pay", "carte", "karte", "tarjeta", "carta", "crédit", "kredit")),
    Kind("phone", r"\+[0-9]", "", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, ("phone", "tel", "call", "mobile", "téléphone", "telefon", "teléfono", "appel", "anruf", "llamar", "handy", "móvil")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}", "", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])", 0.9, ("iban", "account", "bank", "compte", "konto", "cuenta", "banque", "banco", "conto")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, ("ssn", "social security", "tax id")),
    Kind("secret", r"(?i)(?:key|token|secret|password|passwd)[\"']?\s?[:=]", "", r"(?i)(?<![a-z])(?:api[_-]?key|(?:access|private|secret)[_-]?key|(?:access|auth)[_-]?token|token|secret|password|passwd)[\"']?\s?[:=]\s?[\"']?[a-z0-9_+/=.-]{12,512}+", 0.8, ("secret", "private", "login", "credential", "geheim", "secreto")),
)
BASE = ("email", "ip", "card", "phone")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(acc, d):  # noqa: E306
        twice = d * 2
        return F.struct((acc["sum"] + F.when(acc["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda acc: acc["sum"] % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its mod-97 check."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    fold = lambda acc, c: (acc * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), fold) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^[0-9]{0,3}$") & (F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int")).otherwise(999) <= 255))
    if kind == "card":
        return F.when(digits.between(16, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return digits.between(8, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _spans_of(kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score); null where the guard finds nothing."""
    worked = text
    if kind.joints:
        worked = F.regexp_replace(F.translate(text, JOIN, OTHER), kind.joints, JOIN)
    pieces = F.split(worked, kind.pattern, -1)
    matches = F.regexp_extract_all(worked, F.lit(kind.pattern), F.lit(0))

    def sized(x):
        near = F.concat(F.right(x["0"], F.lit(WINDOW)), F.lit(" "), F.left(x["1"], F.lit(WINDOW)))
        return F.struct(F.length(x["0"]).alias("gap"), F.length(x["2"]).alias("len"), x["2"].alias("match"), F.lower(near).alias("near"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["near"].alias("near"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    def located(each):
        """Spans from the lengths of gaps and matches: sums over runs, sums of those, and sums within each run."""
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(each) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(each, k + 1, F.lit(RUN)))
        none = F.array().cast("array<struct<start:int,end:int,match:string,near:string>>")
        whole = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"]))
        begins = F.aggregate(whole, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        inside = lambda r, begin: F.aggregate(r, F.struct(begin.alias("at"), none.alias("found")), step, lambda acc: acc["found"])
        return F.flatten(F.zip_with(runs, F.slice(begins, F.lit(1), F.size(runs)), inside))

    def scored(s):
        lift = F.when(s["near"].rlike(rf"(?<!\p{{L}})(?:{'|'.join(kind.words)})s?(?!\p{{L}})"), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.lit(kind.score) + lift).alias("score"))

    def spans(found):
        n = F.size(found["matches"])
        each = F.arrays_zip(F.slice(found["pieces"], F.lit(1), n).alias("0"), F.slice(found["pieces"], F.lit(2), n).alias("1"), found["matches"].alias("2"))
        placed = bound(F.transform(each, sized), located)
        return F.transform(F.filter(placed, lambda s: confirmed(kind.name, s["match"])), scored)

    found = F.struct(pieces.alias("pieces"), matches.alias("matches"))
    return F.when(text.rlike(kind.guard), bound(found, spans))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find_pii(documents: DataFrame, accept: float = 0.5, kinds: tuple = KINDS) -> DataFrame:
    """doc_id and ``found``: spans (kind, start, end, score; code points, end exclusive) by kind as listed, then start."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    columns = [F.coalesce(F.filter(_spans_of(k, F.col("text")), lambda s: s["score"] >= accept), empty) for k in kinds]
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.concat(*columns).alias("found"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("found", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores.alias("scores"))
