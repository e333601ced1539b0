"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their scores.

Everything is an expression over one text column. The patterns find the leftmost non-overlapping matches of the plain
forms named beside them; possessive repeats and a check of the character before a match keep them linear on long runs.
No match contains a line feed, nor does any need one, so a text of any length is a sequence of short strings.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.helpers import let, running

#: Code points on either side of a span in which context words count.
CONTEXT = 40
CONTEXT_BONUS = 0.3


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` proposes, ``valid`` confirms a match or drops it, ``score`` is that of a confirmed match without
    context, ``words`` raise it, and spans below ``least`` are not reported.
    """

    name: str
    pattern: str
    score: float
    words: str
    least: float = 0.0

    def valid(self, match: Column) -> Column:
        return VALID[self.name](match)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum: every second digit from the right doubled, 9 taken off above 9."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(
        c.cast("int") * (F.lit(1) + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)
    ))
    return F.aggregate(figures, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes ISO 7064: the first four characters moved to the end, letters as 10 to 35, rest 1."""
    turned = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))

    def step(acc, c):
        code = F.ascii(F.upper(c))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def length_between(low: int, high: int):
    return lambda text: F.length(text).between(low, high)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.left(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), F.lit(19)).try_cast("long") <= 255)),
    "card": lambda m: let(digits(m), lambda d: F.when(length_between(16, 19)(d), luhn(d)).otherwise(F.lit(False))),
    "phone": lambda m: length_between(8, 15)(digits(m)),
    "iban": lambda m: let(F.translate(m, " ", ""), mod97),
    "ssn": lambda m: F.lit(True),
    # a word or a sentence has no digits between its letters
    "secret": lambda m: let(F.regexp_replace(m, r"^[^:=]*+[:=][\x20\"']*+", ""), lambda v: v.rlike("[A-Za-z]") & v.rlike("[0-9]")),
}

#: The length of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def iban_pattern() -> str:
    """Country, check digits and as many more characters as the country has, spaces between them aside; in any case."""
    by_length = [rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items()]
    return rf"(?i)(?<![A-Z0-9])(?:{'|'.join(by_length)})(?![A-Z0-9])"


_LOCAL = "A-Za-z0-9._%+-"
#: The base kinds, in their order:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9].
BASE = [
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|schreib|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "address|host|server|login|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|master|amex|credit|debit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|mobile|fax|whatsapp|telefon|llam|appel"),
]
#: Kinds beyond the base. A number like a social security number has no checksum and needs a context word; a secret is a value
#: that is assigned to a name such as token.
ADDED = [
    Kind("iban", iban_pattern(), 0.9, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social security", least=0.6),
    Kind(
        "secret",
        r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|passwor[dt]|passwd|pwd)[\"']?\x20?[:=]\x20?[\"']?[a-z0-9_/+.-]{12,}+",
        0.7, "auth|bearer|login|credential|deploy",
    ),
]


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, value, score) of the confirmed matches in a non-null text, in text order.

    The pieces between the matches give their places: a match starts where all earlier pieces and matches end. The same
    pieces hold the context.
    """
    pattern = F.lit(kind.pattern)
    located = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, let(
        F.split(text, kind.pattern, -1), lambda gaps: let(
            running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))),
            lambda ends: F.transform(found, lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"),
                F.lower(F.concat(F.right(F.get(gaps, i), F.lit(CONTEXT)), F.lit("\n"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)))).alias("near"),
            )),
        ),
    )))
    scored = F.transform(
        F.filter(located, lambda s: kind.valid(s["value"])),
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.least(F.lit(1.0), F.lit(kind.score) + F.when(s["near"].rlike(kind.words), CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        ),
    )
    reported = F.filter(scored, lambda s: s["score"] >= kind.least) if kind.least else scored
    return F.coalesce(reported, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"))


def find(docs: DataFrame, text: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """Add ``pii_<kind>`` columns, arrays of (kind, start, end, value, score), to doc_id and the text column.

    Places are code points, ends exclusive. A null text is empty. Rows go through one by one, so repeated rows, ties
    and columns of other names don't matter; only doc_id and the text are kept.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", whole.alias("text")).select(
        "doc_id", "text", *[spans_of(F.col("text"), k).alias(f"pii_{k.name}") for k in kinds or BASE + ADDED]
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, all spans as text and, in the same order, their scores, per document."""
    base = F.concat(*[F.col(f"pii_{k.name}") for k in BASE])
    every = F.concat(base, *[F.col(f"pii_{k.name}") for k in ADDED])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )
