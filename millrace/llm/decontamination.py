"""Benchmark decontamination by winnowing.

Of every ``L - k + 1`` consecutive k-grams a document keeps the least hash, so any
span of L words has a kept fingerprint. The benchmark side, which is small, keeps all its
k-grams, so every span of L shared words is sure to be hit. Hits are then extended:
the L-word windows around each matching k-gram are compared with the items'
windows, which gives the exact words that are shared.

An item shorter than L words is one window of its own length. Each of those few
lengths is treated the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import last_at_most, let, lower_ascii, same
from .storage import materialise

#: Fixed value: what separates words, once letters are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Sorted hashes up to this number are looked through one by one, which is quicker then; the answer is the same.
FEW = 32


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def word_hashes(text: Column) -> Column:
    """A hash of each word of a text, in order."""
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _run_at(hashes: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(hashes, i + j) for j in range(n)))


def _full(runs: Column, of: Column, n: int) -> Column:
    """Without the last n - 1, which would reach beyond the end."""
    return F.when(F.size(of) >= n, F.slice(runs, F.lit(1), F.size(of) - (n - 1))).otherwise(F.array().cast("array<bigint>"))


def _runs(hashes: Column, n: int) -> Column:
    """The hash of each run of n elements. ``hashes`` must be a column or a lambda's variable."""
    return _full(F.transform(hashes, lambda _, i: _run_at(hashes, i, n)), hashes, n)


def _fingerprints(hashes: Column, length: int, k: int) -> Column:
    """The winnowed k-gram hashes of a document, each once."""
    window = length - k + 1
    if window == 1:
        return F.array_distinct(_runs(hashes, k))
    least = lambda grams, i: F.least(*(F.get(grams, i + j) for j in range(window)))
    return let(
        _runs(hashes, k),
        lambda grams: F.array_distinct(_full(F.transform(grams, lambda _, i: least(grams, i)), grams, window)),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, k: int = 5, least: int = 1,
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside a shared window) and ``items`` (ids, sorted as text).

    One row per row of ``docs``, with ``doc`` and ``text_hash``, a hash of the text.
    Null and empty texts have no words and no hits; such items match nothing. Rows
    with the same id and text get the same result; rows with the same id and
    different texts are told apart. An empty benchmark gives no hits. Very long texts are searched whole, in time
    that grows little faster than their length, also where all their words are shared.

    Only (id, hash) rows are shuffled in the search, and only documents with a matching
    fingerprint are read again. Items of fewer than ``least`` words match nothing; others of fewer than ``window`` are one window. Joins are on hashes; sides that turn out small are
    broadcast by their measured size, and a hash that very many documents share is
    split by the skew join.
    """
    key = (doc, "text_hash")
    side = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("w"))
    side = materialise(side.where(F.size("w") >= max(least, 1)), "benchmark-words")
    lengths = side.select(F.least(F.size("w"), F.lit(window)).alias("n")).distinct()
    lengths = sorted(r.n for r in lengths.collect())  # at most ``window`` numbers
    docs = docs.select(F.col(doc), F.col(text).alias("_text"), F.xxhash64(text).alias("text_hash"))

    sized = docs.select(*key, F.size(_words(F.col("_text"))).cast("bigint").alias("n_words"))
    if not lengths:
        return sized.withColumns({"n_hit": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>")})

    gram = {n: min(k, n) for n in lengths}
    of = lambda n: F.size("w") == n if n < window else F.size("w") >= n
    exploded = lambda value: F.explode(value).alias("hash")
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    wanted = materialise(
        union([side.where(of(n)).select(F.lit(n).alias("n"), exploded(_runs(F.col("w"), gram[n]))) for n in lengths]).distinct(),
        "benchmark-grams",
    )
    windows = materialise(
        union([side.where(of(n)).select(F.lit(n).alias("n"), "item", exploded(_runs(F.col("w"), n))) for n in lengths]).distinct(),
        "benchmark-windows",
    )

    # Winnowed fingerprints of the documents that some item has too.
    marked = docs.select(*key, let(word_hashes(F.col("_text")), lambda w: _prints(w, lengths, gram)).alias("prints"))
    marked = marked.select(*key, F.explode("prints").alias("p")).select(*key, F.col("p.n").alias("n"), exploded(F.col("p.hashes")))
    met = marked.join(wanted, ["n", "hash"]).groupBy(*key).agg(F.collect_set(F.struct("n", "hash")).alias("met"))
    met = materialise(met, "benchmark-candidates")

    # The windows around each hit, compared with the items' windows.
    near = docs.join(met, same(docs, met, *key)).select(*(docs[c] for c in key), "_text", "met")
    near = near.select(*key, let(word_hashes(F.col("_text")), lambda w: _around(w, F.col("met"), lengths, gram)).alias("around"))
    near = near.select(*key, F.explode("around").alias("a")).select(*key, "a.*")
    hits = materialise(near.join(windows, ["n", "hash"]).select(*key, "n", "start", "item").distinct(), "benchmark-hits")

    inside = lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)
    places = hits.groupBy(*key).agg(
        F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), inside)))).cast("bigint").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    found = sized.join(places, same(sized, places, *key), "left")
    return found.select(
        *(sized[c] for c in (*key, "n_words")),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _prints(w: Column, lengths: list[int], gram: dict[int, int]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("n"), _fingerprints(w, n, gram[n]).alias("hashes")) for n in lengths))


def _around(w: Column, met: Column, lengths: list[int], gram: dict[int, int]) -> Column:
    """Windows of a document that contain a matching k-gram: length, first word (from 0) and hash."""

    def windows(n: int) -> Column:
        k = gram[n]
        wanted = F.array_sort(F.transform(F.filter(met, lambda m: m["n"] == n), lambda m: m["hash"]))

        def starts(grams: Column, wanted: Column) -> Column:
            # ``wanted`` is sorted; a few hashes are looked through, many are halved.
            is_wanted = lambda g: F.when(F.size(wanted) <= FEW, F.array_contains(wanted, g)).otherwise(last_at_most(wanted, g) == g)
            at = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: is_wanted(F.get(grams, i)))
            first = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (n - k), F.lit(0)), i)))
            last = F.size(grams) - 1 - (n - k)
            return F.filter(F.array_distinct(first), lambda s: s <= last)

        chosen = let(_runs(w, k), lambda grams: let(wanted, lambda found: F.when(F.size(grams) > 0, starts(grams, found))))
        each = F.transform(
            chosen,
            lambda s: F.struct(F.lit(n).alias("n"), s.alias("start"), _run_at(w, s, n).alias("hash")),
        )
        return F.coalesce(each, F.array().cast("array<struct<n:int,start:int,hash:bigint>>"))

    return F.concat(*(windows(n) for n in lengths))
