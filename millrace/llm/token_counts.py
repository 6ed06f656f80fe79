"""Token counts by the whole-token shortcut.

Byte-level BPE first cuts a text into pre-tokens and merges each on its own. Most
pre-tokens of ordinary text are whole vocabulary entries. Which entries encode
alone as one token is proved once, by encoding every one of them; those pre-tokens
count one each, and only the rest is merged, by the tokenizer itself.

Texts are cut as numpy arrays of byte classes: runs of letters, digits, other signs
and white space, with the pattern's rules for a leading space and for contractions.
``character_classes`` compares that classing with the tokenizer's own cut, code
point by code point; texts with any other code point, with white space beyond
ASCII, or with the string of a special token are given to the tokenizer whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import Texts, pieces, running_hashes

#: Fixed value: the pattern of byte-level pre-tokenizers that use a regular expression.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a Python worker remembers; past that it starts anew.
REMEMBERED = 500_000
#: Code points whose class is tested: all below CJK's radicals, then CJK, Hangul and full width.
TESTED = ((0, 0x2E80), (0x3000, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFF00, 0xFFF0))

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)


def _cuts(tokenizer: Tokenizer, text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def single_tokens(tokenizer: Tokenizer) -> list[str]:
    """The vocabulary's strings that the tokenizer encodes as one token, shown by encoding each."""
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for i, (t, e) in enumerate(zip(texts, found)) if e.ids == [i] and regex.fullmatch(PRE_TOKEN, t)]


def character_classes(tokenizer: Tokenizer) -> np.ndarray:
    """The class of every code point below 65,536; UNKNOWN where the tokenizer cuts otherwise or was not asked."""
    cut = regex.compile(PRE_TOKEN)
    classes = np.full(0x10000, UNKNOWN, np.uint8)
    kinds = [(SPACE, regex.compile(r"\s")), (LETTER, regex.compile(r"\p{L}")), (DIGIT, regex.compile(r"\p{N}"))]
    step = 512
    for low, high in TESTED:
        for part in range(low, high, step):
            points = range(part, min(part + step, high))
            tests = ["a{0}a 1{0}1 !{0}! {0}  {0}\n\n".format(chr(p)) for p in points]
            whole = "\n".join(tests)
            alike = _cuts(tokenizer, whole) == cut.findall(whole)
            for p, test in zip(points, tests):
                if alike or _cuts(tokenizer, test) == cut.findall(test):
                    kind = next((k for k, pattern in kinds if pattern.match(chr(p))), OTHER)
                    classes[p] = kind if kind != SPACE or p < 0x80 else UNKNOWN
    return classes


def byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    kind = classes[:256][data]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        kind[wide] = UNKNOWN
        at = wide[(data[wide] >= 0xC0) & (data[wide] < 0xE0)]
        two = classes[((data[at] & 0x1F).astype(np.int64) << 6) | (data[at + 1] & 0x3F)]
        kind[at] = kind[at + 1] = two
        at = wide[(data[wide] >= 0xE0) & (data[wide] < 0xF0)]
        point = ((data[at] & 0x0F).astype(np.int64) << 12) | ((data[at + 1] & 0x3F).astype(np.int64) << 6)
        three = classes[point | (data[at + 2] & 0x3F)]
        kind[at] = kind[at + 1] = kind[at + 2] = three
    return kind


def pre_token_starts(texts: Texts, kind: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, for rows without UNKNOWN characters."""
    data = texts.data
    n = len(data)
    row_start = np.zeros(n + 1, bool)
    row_start[texts.offsets] = True
    change = row_start[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change)
    start = np.zeros(n, bool)
    visible = runs[kind[runs] != SPACE]
    start[visible] = True
    spaces = runs[kind[runs] == SPACE]
    start[spaces] = True
    # The last character of white space before a visible one stands apart, and a blank joins what follows.
    followed = visible[(~row_start[visible]) & (visible > 0)]
    followed = followed[kind[followed - 1] == SPACE]
    start[followed - 1] = True
    start[followed[data[followed - 1] == 0x20]] = False
    # An apostrophe that nothing precedes takes the letters of a contraction.
    mark = visible[data[visible] == 0x27]
    mark = mark[start[mark]]
    padded = np.zeros(n + 3, np.uint8)
    padded[:n] = data
    row_end = np.zeros(n + 4, bool)
    row_end[texts.offsets] = True
    one, two = padded[mark + 1], padded[mark + 2]
    inside = ~row_end[mark + 1]
    short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    pairs = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
    pairs |= (one == ord("l")) & (two == ord("l"))
    long = inside & ~row_end[mark + 2] & pairs
    for chosen, length in ((short, 2), (long, 3)):
        at = mark[chosen]
        start[at + 1] = False
        after = at + length
        after = after[after < n]
        start[after] |= (kind[after] != SPACE) | start[after]
    return np.flatnonzero(start)


class PieceCounter:
    """Counts the tokens of texts with one tokenizer; made once per Python worker."""

    def __init__(self, source: str, singles: list[str], classes: np.ndarray):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.classes = classes
        self.special = [t["content"].encode() for t in json.loads(source)["added_tokens"] if t["content"]]
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        alone = [s.encode() for s in singles]
        ends = np.cumsum([len(s) for s in alone])
        data = np.frombuffer(b"".join(alone), np.uint8)
        hashes = running_hashes(data, ends - [len(s) for s in alone], ends)
        order = np.argsort(hashes)
        self.proved = (hashes[order], np.ones(len(order), np.int64))
        self.hashes, self.counts = self.proved

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow column; null is empty."""
        total = np.zeros(len(column), np.int64)
        for texts in pieces(column):
            total[texts.first : texts.first + len(texts.offsets) - 1] = self._count(texts)
        return total

    def _count(self, texts: Texts) -> np.ndarray:
        n_rows, data, offsets = len(texts.offsets) - 1, texts.data, texts.offsets
        if len(data) == 0:
            return np.zeros(n_rows, np.int64)
        raw = data.tobytes()
        kind = byte_classes(data, self.classes)
        whole = np.zeros(n_rows, bool)
        whole[np.searchsorted(offsets, np.flatnonzero(kind == UNKNOWN), "right") - 1] = True
        if any(s in raw for s in self.special):
            whole |= [any(s in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1], offsets[1:])]
        starts = pre_token_starts(texts, kind)
        ends = np.append(starts[1:], len(data))
        rows = np.searchsorted(offsets, starts, "right") - 1
        if whole.any():
            keep = ~whole[rows]
            starts, ends, rows = starts[keep], ends[keep], rows[keep]
        unique, first, which = np.unique(running_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths = self._lengths(unique, starts[first], ends[first], raw)
        total = np.bincount(rows, lengths[which], n_rows).astype(np.int64)
        for row in np.flatnonzero(whole):
            text = raw[offsets[row] : offsets[row + 1]].decode()
            total[row] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return total

    def _lengths(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        """Tokens of distinct pre-tokens, given in order of their hashes."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        lengths = np.where(known, self.counts[at], 0)
        new = np.flatnonzero(~known)
        if len(new):
            lengths[new] = self._merged([raw[a:b].decode() for a, b in zip(starts[new], ends[new])])
            if len(self.hashes) + len(new) > len(self.proved[0]) + REMEMBERED:
                self.hashes, self.counts = self.proved
            if len(new) <= REMEMBERED:
                to = np.searchsorted(self.hashes, hashes[new])
                self.hashes = np.insert(self.hashes, to, hashes[new])
                self.counts = np.insert(self.counts, to, lengths[new])
        return lengths

    def _merged(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token. Those with a visible end go in one text, a line
        each: a line end between such pieces is always a pre-token of its own."""
        blank = np.array([t.isspace() for t in texts])
        lengths = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(blank):
            lengths[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        lines = "".join(t + "\n" for t, b in zip(texts, blank) if not b)
        if lines:
            ids = np.asarray(self.tokenizer.encode(lines, add_special_tokens=False).ids)
            lengths[~blank] = np.diff(np.flatnonzero(ids == self.line_end), prepend=-1) - 1
        return lengths


_made: dict[int, PieceCounter] = {}


def token_counter(spark: SparkSession, tokenizer_path: str):
    """A function from a text column to its number of tokens. Null counts as empty.

    The tokenizer's file is read on the driver and sent along with what was proved
    about it; both are of the file's size, whatever the data.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    tokenizer = Tokenizer.from_str(source)
    shared = spark.sparkContext.broadcast((source, single_tokens(tokenizer), character_classes(tokenizer)))
    key = hash(source)

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        if key not in _made:
            _made.clear()
            _made[key] = PieceCounter(*shared.value)
        return pa.array(_made[key].count(texts))

    return n_tokens


def count_tokens(
    df: DataFrame, tokenizer_path: str, *, text: str | Column = "text", limit: int = 1024
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each;
    no row is moved, so texts of any length and any distribution cost one pass.
    Columns of the same names are replaced. An empty table gives an empty table.
    """
    text = F.col(text) if isinstance(text, str) else text
    counter = token_counter(df.sparkSession, tokenizer_path)
    return df.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), "n_tokens": counter(text)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
