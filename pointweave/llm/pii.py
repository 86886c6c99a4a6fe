"""Personal data in texts: patterns propose spans, checksums and ranges confirm them, context words move the score."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

#: Code points before a span in which its context words count.
CONTEXT = 40
ACCEPT = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97: the first four characters go last, letters count from 10."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    chars = F.split(moved, "(?<=.)(?=.)")

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(chars, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern, a character that every match holds, check of a match, score and context words.

    Patterns use possessive repeats and start only where a run of their first class starts (or a match has just
    ended), which finds the same leftmost matches in time linear in the text.
    """

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.length(d).between(13, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))


def _ip(m: Column) -> Column:
    part = F.regexp_replace(m, r"(^|\.)0+(?=[0-9])", "$1")
    return F.forall(F.split(part, r"\."), lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda m: F.lit(True),
        0.9,
        "mail|contact|write to|reply",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".",
        _ip,
        0.6,
        "ip|host|server|address|login",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 0.8, "card|visa|credit|payment|expires"),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        lambda m: F.length(_digits(m)).between(9, 15),
        0.7,
        "phone|call|tel|mobile|fax",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        "",
        lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))),
        0.8,
        "iban|account|bank|transfer",
        base=False,
    ),
    Kind(
        "account",
        r"(?<![A-Za-z0-9.+-])[0-9]{8,12}(?![A-Za-z0-9.-])",
        "",
        lambda m: F.lit(True),
        0.3,
        "account|passport|licence no|license no|social security|customer no|tax id",
        base=False,
    ),
)


def _prefix_sums(lengths: Column) -> Column:
    """Sum of all earlier lengths at each place, by blocks of 64 so that long lists stay cheap."""
    add = lambda a, x: a + x
    total = lambda x: F.aggregate(x, F.lit(0), add)

    def placed(n: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), (F.size(n) / 64).cast("int")), lambda b: total(F.slice(n, b * 64 + 1, F.lit(64)))
        )
        return let(
            let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))),
            lambda before: F.transform(
                n,
                lambda _, i: F.get(before, (i / 64).cast("int"))
                + total(F.slice(n, (i / 64).cast("int") * 64 + 1, i % 64)),
            ),
        )

    return let(lengths, placed)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order: start and end count code points, end exclusive.

    Matches and the gaps between them come from two scans with the same pattern; running sums of their lengths are the
    positions. Context words in the CONTEXT code points before a span add to its score; kinds that are not base are
    dropped below ACCEPT.
    """
    none = F.array().cast(SPAN)

    def build(m: Column) -> Column:
        gaps = F.split(text, kind.pattern)
        starts = let(
            gaps,
            lambda g: F.zip_with(
                _prefix_sums(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i)))),
                F.slice(g, 1, F.size(m)),
                lambda a, x: a + F.length(x),
            ),
        )

        def span(x: Column, start: Column) -> Column:
            lead = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
            near = F.when(lead.rlike(rf"(^|[^a-z])({kind.words})([^a-z]|$)"), 0.25).otherwise(0.0)
            return F.when(
                kind.valid(x),
                F.struct(
                    F.lit(kind.name).alias("kind"),
                    start.alias("start"),
                    (start + F.length(x)).alias("end"),
                    F.least(F.lit(kind.score) + near, F.lit(1.0)).alias("score"),
                ),
            )

        keep = lambda s: s.isNotNull() if kind.base else s.isNotNull() & (s["score"] >= ACCEPT)
        return F.filter(F.zip_with(m, starts, span), keep).cast(SPAN)

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, build(m)).otherwise(none))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii, the spans of every kind in the order of KINDS and then of their start.

    A null text is empty and has none. Any length is read whole. text_col is the only column read; others are kept, but
    one called pii gives way to the result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.concat(*[spans_of(text, k) for k in KINDS]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii_spans(spark, sf_dir) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long")
    return docs.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
    )


#: Matches as (kind, pattern without lookaround, check on the match m and its digits g).
_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+){3}",
     "len([p for p in string_split(m, '.') if CAST(p AS HUGEINT) > 255]) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", """length(g) BETWEEN 13 AND 19 AND list_sum([
        CASE WHEN i % 2 = 0 THEN CAST(g[length(g) - i] AS INT)
             WHEN CAST(g[length(g) - i] AS INT) > 4 THEN CAST(g[length(g) - i] AS INT) * 2 - 9
             ELSE CAST(g[length(g) - i] AS INT) * 2 END for i in range(length(g))]) % 10 = 0"""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15"),
)


def _sql() -> str:
    parts = [
        f"""SELECT doc_id, {i} AS o, '{name}' AS kind, m, g, s, s + length(m) AS e FROM (
  SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS g,
         list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS s
  FROM (SELECT doc_id, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d))
) WHERE {check}"""
        for i, (name, p, check) in enumerate(_SQL_KINDS)
    ]
    joined = "coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, s), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
{' UNION ALL '.join(parts)}
), n AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, {joined} AS j
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(j, '')) AS base_sha256, coalesce(j, '') AS spans
FROM d LEFT JOIN n USING (doc_id)
"""


SQL = _sql()
