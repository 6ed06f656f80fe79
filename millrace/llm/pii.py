"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is built-in column functions over one row, so nothing is shuffled. Spark's
functions give the matches of an expression but not their places; the text split
at the same expression gives the stretches in between, and lengths of both add up
to code-point offsets.

The expressions are written so that a long run of characters is entered once
(``\\G`` or a look-behind at its start) and left without backtracking (possessive
repetition): a text of any length costs time in proportion and no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import last_at_most, let

#: Spans scoring at least this are reported; base kinds always are.
THRESHOLD = 0.6
#: Characters before a span that are searched for context words, and what one is worth.
CONTEXT_CHARS = 40
CONTEXT_WORTH = 0.4
_BLOCK = 64


def luhn(digits: Column) -> Column:
    """Whether a short string of digits has the check digit that payment cards use."""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(digits, -i, F.lit(1))) - 48
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks has the remainder 1 that IBANs have."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(turned, "", -1), F.lit(0), lambda r, s: F.when(s == "", r).otherwise(step(r, s))) == 1


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _length_between(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.when(_length_between(digits, 12, 19), luhn(digits)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: the expression, a cheap test that must hold for it to
    match at all, the check of a match, its score, and words that raise the score."""

    name: str
    pattern: str
    possible: str
    check: Callable[[Column], Column]
    score: float
    context: str | None = None


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 1.0),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]",
         lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}"), 1.0),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", _card, 1.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: _length_between(_digits(m), 9, 15), 1.0),
)
#: Kinds that the method adds. Their matches count only beside the base spans.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", lambda m: mod97(F.regexp_replace(m, " ", "")), 0.9, "iban|account|konto|compte|cuenta"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security"),
    Kind("local_phone", r"(?<![0-9+.-])\(?0[0-9]{1,4}\)?[ /-][0-9][0-9 -]{4,10}[0-9](?![0-9])", "0[0-9]",
         lambda m: _length_between(_digits(m), 7, 13), 0.3, "phone|tel|call|mobile|fax|ruf|appel|llam"),
)


def running_sum(numbers: Column) -> Column:
    """Sums up to and with each element, by blocks, so that long arrays cost little more than short ones.

    ``numbers`` must be a column or a lambda's variable, as it is looked up many times.
    """
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    block = lambda b: F.slice(numbers, b + 1, F.lit(_BLOCK))
    within = lambda part, before: F.transform(part, lambda _, i: before + add(F.slice(part, F.lit(1), i + 1)))

    def blocks(starts: Column) -> Column:
        return let(
            F.transform(starts, lambda b: add(block(b))),
            lambda sums: F.flatten(
                F.transform(
                    starts,
                    lambda b, k: let(block(b), lambda part: let(add(F.slice(sums, F.lit(1), k)), lambda before: within(part, before))),
                )
            ),
        )

    return F.when(F.size(numbers) > 0, let(F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(_BLOCK)), blocks))


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(kind: Kind, rank: int, text: Column) -> Column:
    """The confirmed spans of one kind."""

    def step(found: Column, between: Column) -> Column:
        before = lambda i: F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)
        return F.transform(found, lambda _, i: F.length(F.get(between, i)) + before(i))

    def span(found: Column, i: Column, between: Column, starts: Column) -> Column:
        start = F.get(starts, i)
        score = F.lit(kind.score)
        if kind.context:
            near = F.lower(F.right(F.get(between, i), F.lit(CONTEXT_CHARS)))
            score = score + F.when(near.rlike(rf"(?:^|[^a-z])(?:{kind.context})"), CONTEXT_WORTH).otherwise(0.0)
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(found)).alias("end"),
            F.lit(kind.name).alias("kind"), score.alias("score"), kind.check(found).alias("good"),
        )

    def confirmed(found: Column) -> Column:
        return let(
            F.split(text, kind.pattern, -1),
            lambda between: let(
                step(found, between),
                lambda steps: let(
                    running_sum(steps),
                    lambda starts: F.filter(
                        F.transform(found, lambda m, i: span(m, i, between, starts)),
                        lambda s: s["good"] & (s["score"] >= THRESHOLD),
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    good = F.when(text.rlike(kind.possible), let(found, lambda m: F.when(F.size(m) > 0, confirmed(m))))
    bare = F.transform(good, lambda s: F.struct(*(s[n].alias(n) for n in ("start", "rank", "end", "kind", "score"))))
    return F.coalesce(bare, F.array().cast(_SPAN))


def find_personal_data(df: DataFrame, *, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """Add the base spans and all spans of each row's text, in order of start, then kind.

    A span has start, rank (of its kind), end (exclusive), kind and score; places are
    code points. Matches are leftmost and do not overlap within a kind; a match that
    fails its check is dropped and not tried again. Added kinds give way to base
    spans that they overlap. Null and empty texts have no spans. Rows stay where they
    are, repeated or not; columns named like the two results are replaced.
    """
    content = F.col(text)
    each_of = lambda kinds, first: [_spans(k, first + i, content) for i, k in enumerate(kinds)]

    def reaches(of_kind: Column, s: Column) -> Column:
        # Spans of one kind rise and do not overlap, so of those that start before s ends the last ends last.
        nearest = last_at_most(of_kind, s["end"] - 1, lambda b: b["start"])
        return F.coalesce(let(nearest, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), F.lit(False))

    def both(kinds: Column) -> Column:
        more = F.filter(F.concat(*each_of(ADDED, len(BASE))), lambda s: ~F.exists(kinds, lambda of_kind: reaches(of_kind, s)))
        return let(
            F.flatten(kinds),
            lambda found: F.struct(F.array_sort(found).alias("base"), F.array_sort(F.concat(found, more)).alias("all")),
        )

    df = df.withColumn("_personal", let(F.array(*each_of(BASE, 0)), both))
    return df.withColumns({base: F.col("_personal.base"), spans: F.col("_personal.all")}).drop("_personal")


def span_list(spans: Column) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
