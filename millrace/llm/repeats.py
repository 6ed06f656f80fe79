"""Removal of passages that an earlier document has, by longest previous factors in suffix order.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of smaller id. In the
sorted order of suffixes, equal beginnings are neighbours: the nearest suffixes before and after one
that come from smaller documents (previous and next smaller values) have the longest matches with an
earlier text, and the string goes if such a factor reaches ``LENGTH``. Only that much of a suffix decides, so
suffixes are compared no further.

Sorting every suffix of a corpus in one order would shuffle many times its size. Strings with no partner
are left out first, exactly:

* The least hash of the ``GRAM``-byte grams in a string is its anchor. Equal strings have equal anchors, and some
  seventeen strings in a row share one. Documents are dealt into blocks of bounded size; each block sends its
  anchors with the least and greatest document, and learns which are in several documents.
* Only for those each block sends the stretch of text that the strings of an anchor cover, each different one
  once. Suffixes meet by anchor and are put in order there. Where very many texts share an anchor, its strings
  are dealt singly, by their own hash.
* Blocks hear which strings have an earlier match, mark their bytes and cut them out.

Blocks and groups send packed columns, not a row per string. The texts are shuffled once and read three times; no
group holds more than one block's text or, per block, one stretch of each kind.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import SENT, answered, block_size, bucket_of, messages, pack, sent, starts_of, steps, unpack
from .words import mix, pieces

LENGTH = 50
GRAM = 18
#: An anchor in more texts than this (counted with repeats) has its strings dealt singly.
HOT = 4096
#: At most so many strings in a row are one stretch; their marks are one number.
STRETCH = 32
#: Bounds of a block's bytes.
LEAST_BLOCK, MOST_BLOCK = 1 << 20, 1 << 27
_KEY_BITS = 48
_NO_ID = np.iinfo(np.int64).max

_U64 = np.uint64
_C = _U64(0x9E3779B97F4A7C15)


# --- strings and their anchors


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first string's place, number of strings, anchor) of each run of strings with one anchor.

    ``data`` has the rows' bytes end to end. A run is cut after ``STRETCH`` strings.
    """
    none = np.zeros(0, np.int64)
    n, grams = len(data), len(data) - gram + 1
    if n < length:
        return none, none, none, none.astype(np.uint64)
    words = np.ndarray(n - 7, "<u8", data, strides=(1,))
    h = np.zeros(grams, np.uint64)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        h = (h ^ words[at : at + grams]) * _C
        h ^= h >> _U64(29)
    h = h * _C
    least, span, window = h ^ (h >> _U64(32)), 1, length - gram + 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    sizes = np.diff(offsets) - length + 1
    long_ = np.flatnonzero(sizes > 0)
    change = np.zeros(len(least) + 1, np.int8)
    change[offsets[long_]] += 1
    change[offsets[long_] + sizes[long_]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    new = np.append(True, least[1:] != least[:-1])
    new[offsets[long_]] = True
    first = np.flatnonzero(new & inside)
    row = np.searchsorted(offsets, first, "right") - 1
    count = np.minimum(np.append(first[1:], n), offsets[row] + sizes[row]) - first
    anchor = mix(least[first])  # least hashes are small ones; spread again, groups are even
    if len(count) and count.max() > STRETCH:
        times = -(-count // STRETCH)
        which = np.repeat(np.arange(len(first)), times)
        part = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        count = np.minimum(count[which] - part * STRETCH, STRETCH)
        row, first, anchor = row[which], first[which] + part * STRETCH, anchor[which]
    return row, first, count, anchor


def hashes(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of ``size`` bytes from each place; at least eight bytes follow the last one."""
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    h = size.astype(np.uint64) * _C
    for k in range(0, int(size.max(initial=0)), 8):
        on = size > k
        left = np.clip(size - k, 0, 8)
        mask = np.where(left == 8, ~_U64(0), (_U64(1) << (_U64(8) * left.astype(np.uint64) % _U64(64))) - _U64(1))
        step = (h ^ (words[np.minimum(at + k, len(words) - 1)] & mask)) * _C
        h = np.where(on, step ^ (step >> _U64(29)), h)
    return mix(h)


def gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes from each place, end to end."""
    ends = np.cumsum(size)
    return data[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Block:
    """The texts of one block, their stretches, and the block's anchors as sorted keys."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.length = length
        text = table.column("_text").combine_chunks()
        found, base = [], 0
        parts, ends = [], [np.zeros(1, np.int64)]
        for piece in pieces(text):
            row, at, count, anchor = stretches(piece.data, piece.offsets, length, gram)
            found.append((row + piece.first, at + base, count, anchor))
            parts.append(piece.data)
            ends.append(piece.offsets[1:] + base)
            base += len(piece.data)
        self.offsets = np.concatenate(ends)
        self.padded = np.concatenate([*parts, np.zeros(8, np.uint8)])
        self.data = self.padded[:base]
        none = np.zeros(0, np.int64)
        columns = [np.concatenate(c) for c in zip((none, none, none, none.astype(np.uint64)), *found)]
        self.row, self.at, self.count, self.anchor = columns
        document = table.column("_doc").to_numpy()
        self.document = document[self.row]
        self.keys, self.which = np.unique(self.anchor >> _U64(64 - _KEY_BITS), return_inverse=True)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per key its least and greatest document and the number of its stretches."""
        low = np.full(len(self.keys), _NO_ID)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.document)
        np.maximum.at(high, self.which, self.document)
        return low, high, np.bincount(self.which, minlength=len(self.keys))


class Entries(NamedTuple):
    """The different stretches to compare, by sorted key, and for each stretch of the block which of them it is."""

    key: np.ndarray
    at: np.ndarray
    count: np.ndarray
    document: np.ndarray
    source_at: np.ndarray
    source_document: np.ndarray
    source: np.ndarray


def entries(block: Block, codes: np.ndarray) -> Entries:
    """Stretches of shared anchors whole (code 1), those of hot ones string by string (code 2)."""
    code = codes[block.which]
    one, many = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
    singles = np.repeat(many, block.count[many])
    step = np.arange(len(singles)) - np.repeat(np.cumsum(block.count[many]) - block.count[many], block.count[many])
    at = np.concatenate([block.at[one], block.at[singles] + step])
    count = np.concatenate([block.count[one], np.ones(len(singles), np.int64)])
    content = hashes(block.padded, at, count + block.length - 1)
    key = np.concatenate([block.anchor[one], content[len(one) :]])
    document = np.concatenate([block.document[one], block.document[singles]])
    order = np.lexsort((document, content, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1]))[: len(order)]
    source = np.zeros(len(order), np.int64)
    source[order] = np.cumsum(new) - 1
    first = order[new]
    return Entries(key[first], at[first], count[first], document[first], at, document, source)


def in_earlier(padded: np.ndarray, at: np.ndarray, group: np.ndarray, document: np.ndarray, length: int) -> np.ndarray:
    """For each suffix whether one of its group with the same first ``length`` bytes is from a smaller document.

    Suffixes are sorted within their group, eight bytes at a time and only where they still tie. In that order
    those that tie to the end have common prefixes of ``length`` at least, and each looks for the previous and
    the next smaller document.
    """
    out = np.zeros(len(at), bool)
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    index, tie = np.arange(len(at)), group
    for offset in [None, *sorted({*range(0, length - 7, 8), length - 8})]:
        word = np.zeros(len(index), np.uint64) if offset is None else words[at[index] + offset].astype(np.uint64)
        order = np.lexsort((word, tie))
        index, tie, word = index[order], tie[order], word[order]
        new = np.append(True, (tie[1:] != tie[:-1]) | (word[1:] != word[:-1]))[: len(index)]
        number = np.cumsum(new) - 1
        several = (np.bincount(number) > 1)[number] if len(index) else np.zeros(0, bool)
        index, tie = index[several], number[several]
        if not len(index):
            return out
    _, rank = np.unique(document[index], return_inverse=True)
    _, run = np.unique(tie, return_inverse=True)
    span = len(index) + 1
    # Runs are set apart, so that the least value so far is one of the own run or above all of it.
    before = np.minimum.accumulate(rank - run * span)
    after = np.minimum.accumulate((rank + run * span)[::-1])[::-1]
    previous = np.append(False, before[:-1] < (rank - run * span)[1:])
    following = np.append(after[1:] < (rank + run * span)[:-1], False)
    out[index] = previous | following
    return out


def marks(texts: np.ndarray, key: np.ndarray, count: np.ndarray, document: np.ndarray, length: int) -> np.ndarray:
    """Per stretch, bit j says whether its string j has an earlier match among all of them. ``texts`` lie end to end."""
    padded = np.append(texts, np.zeros(8, np.uint8))
    size = count + length - 1
    at = np.cumsum(size) - size
    content = hashes(padded, at, size)
    order = np.lexsort((document, content, key))
    k, c = key[order], content[order]
    new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
    new = new_key | np.append(True, c[1:] != c[:-1])[: len(k)]
    number = np.cumsum(new) - 1
    first = order[new]
    later = document[order] > document[first][number]
    # Equal stretches are told by their least document; different ones of one anchor go into suffix order.
    of_key = (np.cumsum(new_key) - 1)[new]
    mixed = np.flatnonzero((np.bincount(of_key) > 1)[of_key]) if len(first) else first
    chosen = first[mixed]
    which = np.repeat(np.arange(len(chosen)), count[chosen])
    step = np.arange(len(which)) - np.repeat(np.cumsum(count[chosen]) - count[chosen], count[chosen])
    hit = in_earlier(padded, at[chosen][which] + step, of_key[mixed][which], document[chosen][which], length)
    found = np.zeros(len(first), np.int64)
    np.bitwise_or.at(found, mixed[which[hit]], np.int64(1) << step[hit])
    out = np.zeros(len(key), np.int64)
    every = (np.int64(1) << count) - 1
    out[order] = np.where(later, every[order], found[number])
    return out.astype(np.uint32)


# --- what blocks and groups do


def remove_repeats(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
    block_bytes: int | None = None,
) -> DataFrame:
    """Per row ``doc``, ``n_bytes``, ``spans`` (start and end of the bytes that go) and ``kept`` (all others, binary).

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes over it also starts in the text of a row with a
    smaller id, judged on the texts as they are. Rows of one id do not count against each
    other. A null id is greater than all others (as is the greatest long), so such a row never takes bytes from others. Null and empty
    texts have no bytes and no spans; a text under ``length`` keeps all. Every row comes back; no
    rows give none. A text longer than a block is a block of its own, so it has to fit one task. ``spans`` are disjoint, in order,
    not adjacent. Other columns are not carried. Ids are whole numbers.

    Rows are dealt to blocks by their place in ``docs``, which should therefore be a stored table. Whole stretches
    of one anchor are equal if two 64-bit hashes are; single strings are compared byte by byte.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes at least and no more than a string")
    if str(docs.schema[doc].dataType.typeName()) not in ("long", "integer", "short", "byte"):
        raise ValueError(f"{doc} must be a whole number")
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint")).alias("n")).first()["n"] or 0
    size = block_bytes or block_size(total, LEAST_BLOCK, MOST_BLOCK)
    blocks = max(1, -(-total // size))
    parts = max(1, -(-total // max(16 << 20, 2 * size)))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"),
        F.col(doc).alias("_id"),
        F.coalesce(F.col(doc).cast("bigint"), F.lit(int(_NO_ID))).alias("_doc"),
        F.col(text).alias("_text"),
    ).repartition(parts, "block")

    def name(table: pa.Table) -> int:
        return table.column("block")[0].as_py()

    def send_anchors(table: pa.Table) -> pa.Table:
        block = Block(table, length, gram)
        low, high, n = block.anchors()
        starts = starts_of(bucket_of(block.keys, blocks, _KEY_BITS), blocks)
        return sent(messages(name(table), starts, lambda s: pack(
            steps(block.keys[s]), low[s], high[s] - low[s], np.minimum(n[s], 1 << 30).astype(np.uint32)
        )))

    def find_shared(table: pa.Table) -> pa.Table:
        got = [unpack(blob, np.uint64, np.int64, np.int64, np.uint32)[0] for blob in table.column("blob").to_pylist()]
        ends = np.cumsum([len(g[0]) for g in got])
        key = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
        low, span, n = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        several = np.minimum.reduceat(low[order], first) < np.maximum.reduceat((low + span)[order], first)
        often = np.add.reduceat(n[order].astype(np.int64), first) > hot
        code = np.repeat(several * np.where(often, 2, 1), np.diff(np.append(first, len(key)))).astype(np.uint8)
        codes = np.zeros(len(key), np.uint8)
        codes[order] = code
        bucket = table.column("bucket")[0].as_py()
        return sent((b, bucket, pack(c)) for b, c in zip(table.column("block").to_pylist(), np.split(codes, ends[:-1])) if c.any())

    def prepared(texts: pa.Table, shared: pa.Table) -> tuple[Block, Entries, np.ndarray]:
        block = Block(texts, length, gram)
        codes = answered(shared, starts_of(bucket_of(block.keys, blocks, _KEY_BITS), blocks), np.uint8)
        found = entries(block, codes)
        return block, found, starts_of(bucket_of(found.key, blocks), blocks)

    def send_stretches(texts: pa.Table, shared: pa.Table) -> pa.Table:
        block, found, starts = prepared(texts, shared)

        def packed(s: slice) -> bytes:
            covered = gathered(block.data, found.at[s], found.count[s] + length - 1)
            return pack(steps(found.key[s]), found.document[s], found.count[s].astype(np.uint8), tail=covered.tobytes())

        return sent(messages(name(texts), starts, packed))

    def find_earlier(table: pa.Table) -> pa.Table:
        got = [unpack(blob, np.uint64, np.int64, np.uint8) for blob in table.column("blob").to_pylist()]
        ends = np.cumsum([len(g[0][0]) for g in got])
        key = np.concatenate([np.cumsum(g[0][0], dtype=np.uint64) for g in got])
        document, count = (np.concatenate([g[0][i] for g in got]) for i in (1, 2))
        found = marks(np.concatenate([g[1] for g in got]), key, count.astype(np.int64), document, length)
        bucket = table.column("bucket")[0].as_py()
        return sent((b, bucket, pack(m)) for b, m in zip(table.column("block").to_pylist(), np.split(found, ends[:-1])) if m.any())

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        first = pc.equal(answers.column("stage"), 1)
        block, found, starts = prepared(texts, answers.filter(first))
        mark = answered(answers.filter(pc.invert(first)), starts, np.uint32)[found.source].astype(np.int64)
        every = (np.int64(1) << found.count[found.source]) - 1
        mark = np.where(found.source_document > found.document[found.source], every, mark)
        change = np.zeros(len(block.data) + 1, np.int32)
        for j in range(STRETCH):
            at = found.source_at[(mark >> j) & 1 == 1] + j
            change[at] += 1
            change[at + length] -= 1
        goes = np.cumsum(change[:-1]) > 0
        return _cut_out(texts, block, goes)

    shared = dealt.groupBy("block").applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(find_shared, SENT)
    stretches_ = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_stretches, SENT)
    earlier = stretches_.groupBy("bucket").applyInArrow(find_earlier, SENT)
    answers = shared.withColumn("stage", F.lit(1)).unionAll(earlier.withColumn("stage", F.lit(2)))
    kind = docs.schema[doc].dataType.simpleString()
    out = f"_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    done = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, out)
    return done.select(F.col("_id").alias(doc), "n_bytes", "spans", "kept")


def _cut_out(texts: pa.Table, block: Block, goes: np.ndarray) -> pa.Table:
    offsets, n = block.offsets, len(goes)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(goes & (edge[:-1] | ~np.append(False, goes[:-1])))
    end = np.flatnonzero(goes & (edge[1:] | ~np.append(goes[1:], False))) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    places = [pa.array(x - offsets[row]) for x in (start, end)]
    lists = np.searchsorted(row, np.arange(len(offsets)))
    spans = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(places, ["start", "end"]))
    left = np.append(0, np.cumsum(~goes))[offsets]
    kept = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(block.data[~goes].tobytes())]
    )
    return pa.table({"_id": texts.column("_id"), "n_bytes": pa.array(np.diff(offsets)), "spans": spans, "kept": kept.cast(pa.binary())})
