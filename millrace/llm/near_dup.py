"""Near-duplicate documents by MinHash with one permutation.

A document is its set of word shingles. One hash function sorts the set into bins, the
least hash of a bin is its value, and an empty bin borrows from the first filled one in
a pseudo-random order of its own (optimal densification). Rows of bins make bands; two
documents that agree in a band share a bucket. With 40 bands of 5 rows a pair
at similarity 0.8 shares none in about one case of ten million, a pair at 0.3 shares one
in one of ten.

In a bucket everything is compared with one centre, not with everything, so there are
never more candidates than members. Candidates are confirmed on full sets and linked.
Members of buckets that are then not all connected are looked at again, by an exact filter on
their rarest shingles: no link of a bucket is given up, and large groups of copies are
done after the first star.

Documents with equal sets are one node from the start, however many they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .words import SPACES, byte_table, grams, mix, pieces, words
from .workers import give_back

BANDS = 40
ROWS = 5

_TABLE = byte_table(SPACES, lower=True)
_U64 = np.uint64


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text: ``size`` consecutive words, or the whole
    sequence where there are fewer; none without words."""
    for piece in pieces(column):
        found = words(piece, _TABLE)
        rows = len(piece.offsets) - 1
        n_words = np.bincount(found.row, minlength=rows)
        parts = [grams(found, size)]
        for short in range(1, size):
            at, hashes = grams(found, short)
            whole = n_words[found.row[at]] == short
            parts.append((at[whole], mix(hashes[whole] + _U64(short))))
        at = np.concatenate([p[0] for p in parts])
        hashes = np.concatenate([p[1] for p in parts])
        order = np.argsort(at, kind="stable")
        hashes = hashes[order]
        ends = np.searchsorted(found.row[at[order]], np.arange(rows), "right")
        start = 0
        for end in ends:
            yield np.unique(hashes[start:end])
            start = end


def _probes(bins: int) -> np.ndarray:
    """Per bin, a pseudo-random rank of every bin: the order in which an empty one looks for a value."""
    return mix(np.arange(bins * bins, dtype=np.uint64) + _U64(0x5851F42D4C957F2D)).reshape(bins, bins)


def signature(shingles: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set of hashes."""
    bin_of = ((shingles >> _U64(32)) * _U64(bins)) >> _U64(32)
    first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
    filled = bin_of[first].astype(np.int64)
    values = np.zeros(bins, np.uint64)
    values[filled] = shingles[first]
    empty = np.ones(bins, bool)
    empty[filled] = False
    empty = np.flatnonzero(empty)
    if len(empty):
        values[empty] = values[filled[np.argmin(probes[empty][:, filled], axis=1)]]
    return values


def _signer(size: int, bands: int, rows: int):
    bins = bands * rows
    probes = _probes(bins)

    @F.arrow_udf("struct<n:bigint,a:bigint,b:bigint,bands:array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        total = len(texts)
        n, a, b = (np.zeros(total, np.int64) for _ in range(3))
        keys = np.zeros((total, bands), np.uint64)
        for i, shingles in enumerate(shingle_sets(texts, size)):
            n[i] = len(shingles)
            if n[i]:
                a[i], b[i] = _sums(shingles)
                values = signature(shingles, bins, probes).reshape(bands, rows)
                key = np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    key = mix(key + values[:, k])
                keys[i] = key
        offsets = np.where(n > 0, bands, 0).cumsum()
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, offsets), pa.int32()), pa.array(keys[n > 0].reshape(-1).view(np.int64))
        )
        give_back()
        return pa.StructArray.from_arrays([pa.array(n), pa.array(a), pa.array(b), lists], ["n", "a", "b", "bands"])

    return sign


def _sums(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    first = mix(shingles ^ _U64(0x1B873593CC9E2D51)).sum(dtype=np.uint64)
    second = mix(shingles + _U64(0x38495AB5E6546B64)).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def _set_of(size: int):
    @F.arrow_udf("binary")
    def shingles(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        """The text's set, or null if it is not the one with these sums."""
        wanted = zip(a.to_pylist(), b.to_pylist())
        made = pa.array([s.tobytes() if _sums(s) == w else None for s, w in zip(shingle_sets(texts, size), wanted)], pa.binary())
        give_back()
        return made

    return shingles


def _similar(percent: int):
    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        for i in range(len(left)):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            out[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return pa.array(out)

    return similar


def _size_fits(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def near_duplicates(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked where 100 * common >= ``percent`` * all of their distinct shingles;
    ``component_id`` is the least id that can be reached over links, and ``kept`` says that the
    row has it. Words are lower case (A-Z) and separated by ASCII white space. A null
    text or one without words has no shingles and stands alone. Rows that repeat an id and
    text are copies of each other. A null id never is the least; a component of null ids only
    has a null ``component_id`` and is kept. Other columns are not carried.
    """
    signed = docs.select(F.col(doc), _signer(shingle, bands, rows)(F.col(text)).alias("s")).select(doc, "s.*")
    signed = materialise(signed, "near-signed")
    sets = ("a", "b", "n")
    classes = signed.where("n > 0").groupBy(*sets).agg(F.min(doc).alias("first_id"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    components = _components_of(docs, classes, doc, text, shingle, percent)

    least = classes.select("cls", *sets, "first_id").join(components, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least_id = least.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_set = materialise(least.join(least_id, "comp").select(*sets, "component_id"), "near-components")
    placed = signed.select(doc, *sets).join(by_set, [*sets], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(doc))
    return placed.select(doc, F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col(doc).eqNullSafe(F.col("component_id"))
    )


def _components_of(docs: DataFrame, classes: DataFrame, doc: str, text: str, shingle: int, percent: int) -> DataFrame:
    """``cls`` and ``comp`` for the classes that have a link."""
    entries = classes.select("cls", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = materialise(entries.join(buckets, "key"), "near-members")
    # The centre is the member that meets the most others in all its buckets: of a text and its
    # copies that is the text, to which all are nearer than to each other.
    met = members.groupBy("cls").agg(F.sum("m").alias("met"))
    centres = members.join(met, "cls").groupBy("key").agg(F.max(F.struct("met", "cls")).alias("c")).select("key", F.col("c.cls").alias("centre"))

    # Full sets of the classes in question, from one document of each.
    asked = members.select("cls").distinct().join(classes.select("cls", "first_id", "a", "b"), "cls")
    texts = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).join(asked, F.col("_id").eqNullSafe(F.col("first_id")))
    full = texts.select("cls", _set_of(shingle)(F.col("_text"), F.col("a"), F.col("b")).alias("shingles"))
    full = materialise(full.where("shingles IS NOT NULL").dropDuplicates(["cls"]), "near-sets")
    similar = _similar(percent)
    sizes = classes.select("cls", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("cls").alias("x"), F.col("shingles").alias("sx"))
        right = full.select(F.col("cls").alias("y"), F.col("shingles").alias("sy"))
        return materialise(pairs.join(left, "x").join(right, "y").where(similar("sx", "sy")).select("x", "y"), "near-links")

    # First stars: every member with the bucket's centre.
    stars = members.join(centres, "key").where("cls <> centre").select(F.col("centre").alias("x"), F.col("cls").alias("y"), F.col("n").alias("ny")).distinct()
    stars = stars.join(sizes.select(F.col("cls").alias("x"), F.col("n").alias("nx")), "x").where(_size_fits("nx", "ny", percent))
    tested = materialise(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "near-pairs")
    components = connected(confirmed(tested))

    # Buckets that the stars have not connected, where two members were not compared.
    rest = members.where("m > 2").select("key", "cls", "n").join(components, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rest = materialise(rest, "near-rest")
    apart = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    nodes = materialise(rest.join(apart, "key").select("cls", "n", "comp").distinct(), "near-apart")
    if nodes.isEmpty():
        return components
    pairs = materialise(_across(nodes, full, percent).join(tested, ["x", "y"], "left_anti"), "near-pairs")
    links = confirmed(pairs)
    if links.isEmpty():
        return components
    return merged(components, connected(_between(links, components)))


def _longs():
    @F.arrow_udf("array<bigint>")
    def longs(sets: pa.Array) -> pa.Array:
        parts = [np.frombuffer(s.as_buffer(), np.int64) for s in sets]
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))

    return longs


def _across(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """All pairs (x < y) of different components that can reach the similarity, and few others.

    Shingles are put in order of rarity among the nodes. Two sets that are similar enough have their first
    common shingle early in both: at least as many must follow it, in either, as they have to
    share. So only the rarest shingles of each set are joined, with sets of the sizes for which their place is
    early enough. A copy with too many words of its own has those first, shared with nobody.
    """
    tokens = nodes.join(full, "cls").select("cls", "n", "comp", F.explode(_longs()(F.col("shingles"))).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    sets = tokens.join(often, "token").groupBy("cls", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    alone = F.col("n") - F.size("t")
    early = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    at = sets.select("cls", "n", "comp", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), F.greatest(early, F.lit(0)).cast("int"))))
    at = at.select("cls", "n", "comp", "col.token", (F.col("n") - F.col("alone") - F.col("pos")).alias("left"))
    band = lambda size: F.floor(F.ln(size) * 20).cast("int")  # noqa: E731  sizes within five per cent
    low = F.ceil(F.col("n") * percent / 100)
    high = F.least(F.floor(F.col("n") * 100 / percent), F.floor((100 + percent) * F.col("left") / percent) - F.col("n"))
    ours = at.where(high >= low).select("*", F.explode(F.sequence(band(low), band(high))).alias("band"))
    theirs = at.select(
        F.col("cls").alias("c"), F.col("n").alias("cn"), F.col("comp").alias("ccomp"), "token", F.col("left").alias("cleft"), band(F.col("n")).alias("band")
    )
    enough = (100 + percent) * F.least("left", "cleft") >= percent * (F.col("n") + F.col("cn"))
    met = ours.join(theirs, ["token", "band"]).where((F.col("comp") != F.col("ccomp")) & _size_fits("n", "cn", percent) & enough)
    return met.select(F.least("cls", "c").alias("x"), F.greatest("cls", "c").alias("y")).distinct()


def _between(links: DataFrame, components: DataFrame) -> DataFrame:
    """Links between nodes as links between their components."""
    for end in ("x", "y"):
        named = components.select(F.col("cls").alias(end), F.col("comp").alias("_c"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return links.where("x <> y").distinct()


def merged(components: DataFrame, joins: DataFrame) -> DataFrame:
    """Components after ``joins``, the components of their components."""
    further = joins.select(F.col("cls").alias("comp"), F.col("comp").alias("_to"))
    moved = components.join(further, "comp", "left").select("cls", F.coalesce("_to", "comp").alias("comp"))
    new = joins.join(components.select("cls"), "cls", "left_anti")
    return materialise(moved.unionByName(new), "near-components")


def connected(links: DataFrame) -> DataFrame:
    """``cls`` and ``comp``, the least node of its component, for every end of the links (x, y).

    Each round every node takes the least label among its neighbours' and its own, then the label
    of that label; labels go down to the least node in few rounds for the shallow graphs of stars.
    """
    edges = materialise(
        links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "near-edges"
    )
    labels = edges.groupBy(F.col("x").alias("cls")).agg(F.least(F.min("y"), F.col("cls")).alias("comp"))
    labels = materialise(labels, "near-labels")
    while True:
        heard = edges.join(labels.select(F.col("cls").alias("y"), "comp"), "y").groupBy(F.col("x").alias("cls")).agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, "cls").select("cls", "comp", F.least("comp", "heard").alias("near"))
        jump = labels.select(F.col("cls").alias("near"), F.col("comp").alias("far"))
        after = nearer.join(jump, "near").select("cls", F.col("comp").alias("was"), F.least("near", "far").alias("comp"))
        after = materialise(after, "near-labels")
        if after.where("was <> comp").isEmpty():
            return after.select("cls", "comp")
        labels = after.select("cls", "comp")
