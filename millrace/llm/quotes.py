"""Chat formatting by quotation linking.

Lines that start with ``>`` are quoted, one level per mark. Quoted passages are
normalised and hashed, and the hash finds the message that first said the same: whole passages however
they are wrapped, single lines, and runs of a few words for what is cut and wrapped anew.
The message quoted at the outermost level is the one replied to. Following these links
to their ends gives each message its conversation (the message that all replies
lead back to) and its depth; sorted by conversation, depth and turn, every message comes
after the one it answers, each without what it quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, same
from .storage import materialise

_MARKS = r"^(?:[ \t]*+>)*+"
#: A line that announces a quotation, right before it.
_ANNOUNCES = r"(?i)^\s*(?:on|am|le|el)\s.*(?:wrote|schrieb.*|a écrit|escribió)\s*:\s*$"


def quote_lines(text: Column) -> Column:
    """The lines of a text: ``level`` (0 is the writer's own) and ``line``, without the marks."""
    return F.transform(
        F.split(text, "\r?\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, _MARKS, "").alias("line"),
        ),
    )


def without_quotes(lines: Column) -> Column:
    """The writer's own lines, without announcements of quotations and outer blank lines."""
    size = F.size(lines)
    quoted = lambda i: F.get(lines, i)["level"] > 0
    own = F.filter(
        lines,
        lambda x, i: (x["level"] == 0) & ~((i + 1 < size) & F.coalesce(quoted(i + 1), F.lit(False)) & x["line"].rlike(_ANNOUNCES)),
    )
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s++|(?<!\s)\s++$", "")


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Words of a run: enough that it is rarely said twice by chance.
RUN = 5


def passages(lines: Column) -> Column:
    """Normalised pieces of a message by ``level``: lines, paragraphs, all of a level's consecutive lines, all own lines, and runs of words."""
    plain = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), F.translate(normalised(x["line"]), "\x01\x02", "  ").alias("line")))
    return let(plain, _pieces)


def _pieces(plain: Column) -> Column:
    piece = lambda level, line: F.struct(level.alias("level"), normalised(line).alias("line"))
    # One string, in which each stretch of a level starts with its level; a blank line parts paragraphs.
    changes = lambda x, i: (i == 0) | (F.get(plain, i - 1)["level"] != x["level"])
    marked = F.transform(plain, lambda x, i: F.concat(F.when(changes(x, i), F.concat(F.lit("\x01"), x["level"], F.lit("\x02"))).otherwise(F.lit("\n")), x["line"]))
    stretches = F.transform(
        F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda x: x != ""),
        lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("lines")),
    )
    own = F.array_join(F.transform(F.filter(plain, lambda x: x["level"] == 0), lambda x: x["line"]), " ")
    paragraphs = F.flatten(F.transform(stretches, lambda x: F.transform(F.split(x["lines"], "\n\n+"), lambda y: piece(x["level"], y))))
    whole = F.concat(F.transform(stretches, lambda x: piece(x["level"], x["lines"])), F.array(piece(F.lit(0), own)))
    words = F.transform(whole, lambda x: F.struct(x["level"].alias("level"), F.split(x["line"], " ").alias("words")))
    runs = F.flatten(
        F.transform(
            F.filter(words, lambda x: F.size(x["words"]) > RUN),
            lambda x: F.transform(
                F.sequence(F.lit(1), F.size(x["words"]) - RUN + 1),
                lambda i: F.struct(x["level"].alias("level"), F.array_join(F.slice(x["words"], i, RUN), " ").alias("line")),
            ),
        )
    )
    return F.concat(plain, paragraphs, whole, runs)


def link_quotes(
    messages: DataFrame, *, thread: str = "conv_id", turn: str = "turn", text: str = "text", min_chars: int = 1,
) -> DataFrame:
    """Add ``parent_turn``, ``root_turn``, ``depth`` and ``n_quoted_lines``, and take the quotes out of the text.

    A passage is a line, a paragraph, all consecutive lines of a level, or a run of ``RUN`` words of these,
    with at least ``min_chars`` characters after normalising. Its
    original is the earliest message of the same ``thread`` with that passage (or as all its own text), before the
    quoting one. Of several, the outermost level decides, then the most quoted characters,
    then the later turn. A message whose quotes are not found, or that has none, starts a conversation: ``parent_turn``
    is null, ``root_turn`` its own turn and ``depth`` 0. Null texts stay null; a null turn is never
    linked. Repeated rows are linked alike. Result columns replace those of their names.

    Sums come before joins, so a line that very many messages quote or say is one row
    per thread; no thread is ever in one task. Depths are found by doubling:
    as many rounds as the depth has binary digits.
    """
    results = ("parent_turn", "root_turn", "depth", "n_quoted_lines")
    messages = messages.drop(*results)
    lined = messages.withColumn("_lines", quote_lines(F.col(text)))
    said = lined.where(F.col(turn).isNotNull()).select(F.col(thread).alias("thread"), F.col(turn).alias("turn"), "_lines")

    def hashed(some: DataFrame) -> DataFrame:
        parts = some.select("thread", "turn", F.explode(passages(F.col("_lines"))).alias("l")).where(F.length("l.line") >= min_chars)
        return parts.select("thread", "turn", "l.level", F.xxhash64("l.line").alias("hash"), F.length("l.line").alias("chars"))

    quotes = hashed(said.where(F.exists("_lines", lambda x: x["level"] > 0))).where("level > 0")
    quotes = quotes.groupBy("thread", "turn", "level", "hash").agg(F.max("chars").alias("chars"))
    quotes = materialise(quotes, "quotes")
    if quotes.isEmpty():
        links = None
    else:
        first = hashed(said).where("level = 0").groupBy("thread", "hash").agg(F.min("turn").alias("original"))
        met = quotes.join(first, same(quotes, first, "thread", "hash") & (F.col("original") < F.col("turn")))
        met = met.select(quotes["thread"], "turn", "level", "original", "chars")
        votes = met.groupBy("thread", "turn", "level", "original").agg(F.sum("chars").alias("chars"))
        best = F.max(F.struct((-F.col("level")).alias("l"), "chars", "original"))
        links = votes.groupBy("thread", "turn").agg(best.alias("b")).select("thread", "turn", F.col("b.original").alias("parent"))
        links = materialise(links, "quote-links")

    own = lined.withColumn("n_quoted_lines", F.coalesce(F.size(F.filter("_lines", lambda x: x["level"] > 0)), F.lit(0)))
    own = own.withColumn(text, F.when(F.col("n_quoted_lines") > 0, without_quotes(F.col("_lines"))).otherwise(F.col(text))).drop("_lines")
    if links is None:
        none = F.lit(None).cast(messages.schema[turn].dataType)
        return own.withColumns({"parent_turn": none, "root_turn": F.col(turn), "depth": F.lit(0).cast("bigint")})
    found = _roots(links)
    joined = own.join(found, F.col(thread).eqNullSafe(F.col("_thread")) & (F.col(turn) == F.col("_turn")), "left")
    return joined.withColumns(
        {
            "parent_turn": F.col("_parent"),
            "root_turn": F.coalesce("_root", F.col(turn)),
            "depth": F.coalesce("_depth", F.lit(0)).cast("bigint"),
        }
    ).drop("_thread", "_turn", "_parent", "_root", "_depth")


def _roots(links: DataFrame) -> DataFrame:
    """Every link's last ancestor and its distance, by doubling the reach of each row."""
    at = links.select("thread", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("steps"))
    while True:
        further = at.select(F.col("thread").alias("t"), F.col("turn").alias("via"), F.col("up").alias("top"), F.col("steps").alias("more"))
        reached = at.join(further, F.col("thread").eqNullSafe(F.col("t")) & (F.col("up") == F.col("via")), "left")
        after = materialise(
            reached.select(
                "thread", "turn", F.coalesce("top", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("top").isNotNull().alias("moved"),
            ),
            "quote-roots",
        )
        if after.where("moved").isEmpty():
            break
        at = after.drop("moved")
    tops = after.select(F.col("thread").alias("t"), F.col("turn").alias("u"), F.col("up").alias("_root"), F.col("steps").alias("_depth"))
    both = links.join(tops, F.col("thread").eqNullSafe(F.col("t")) & (F.col("turn") == F.col("u")))
    return both.select(F.col("thread").alias("_thread"), F.col("turn").alias("_turn"), F.col("parent").alias("_parent"), "_root", "_depth")
