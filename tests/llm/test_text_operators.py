"""Operators on single rows: token counts, personal data, quality rules."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.pii import find_personal_data, span_list
from millrace.llm.quality import POLICIES, RULES, Policy, ablations, ledger, verdict
from millrace.llm.token_counts import count_tokens

from . import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    " ", "  ", "\n", "\t", "\x0b", "'s", "'re", "'l", "'", "ll", "a", "re", "B", "1", "²", "é", "!", "<|endoftext|>", "\u3000", "\u00a0",
    "\x1c", "\x00", "\x85", "漢", "😀", "\u200d", "\r\n", "ǅ", "٣", "b@", "@", "c.d", ".", "255", "256", "00", "-", "+4", " (0) ",
    "4111111111111111", "a@b.co_x@y.zz", "1.2.3.4", "#", "the cat sat ", "the cat sat\n",
]


def texts(n, seed, pieces=PIECES, most=40):
    pick = random.Random(seed)
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(0, most))) for _ in range(n)] + [None, "", " "]


def table(spark, values, more=()):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*values, *more])], "doc_id long, text string")


def test_tokens_as_the_library_counts_them(spark):
    library = Tokenizer.from_file(VOCABULARY)
    docs = table(spark, texts(400, 1), ["word " * 50_000, "x" * 200_000, "the cat sat", "the cat sat"])
    for row in count_tokens(docs, VOCABULARY, limit=8).collect():
        expected = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (expected, len((row.text or "").encode()), expected > 8)


def test_tokens_of_an_empty_table_with_a_column_of_the_same_name(spark):
    docs = table(spark, []).where("false").withColumn("n_tokens", F.lit("x"))
    counted = count_tokens(docs, VOCABULARY)
    assert counted.collect() == [] and dict(counted.dtypes)["n_tokens"] == "bigint"


def test_base_spans_as_plain_expressions_find_them(spark):
    docs = table(spark, texts(1500, 2, most=60), ["a@b.cc " * 500])
    for row in find_personal_data(docs).select("text", span_list(F.col("base_spans")).alias("found")).collect():
        assert row.found == brute.personal(row.text), row.text


def test_long_runs_take_linear_time_and_little_stack(spark):
    long = ["x" * 300_000, "1 " * 100_000, "a." * 50_000 + "@" + "b." * 50_000, "1." * 100_000, "+1 " * 30_000]
    counts = [r.n for r in find_personal_data(table(spark, long)).orderBy("doc_id").select(F.size("base_spans").alias("n")).collect()]
    assert counts == [0, 0, 1, 50_000 - 25_000, 0]


@pytest.mark.parametrize("times", [0, 1, 2, 3, 7, 10_000])
def test_added_kinds_give_way_to_any_of_many_base_spans(spark, times):
    one = "tel 030 1234567 , tel 030-1234567@b.cc ; +49 30 1234567 "
    (row,) = find_personal_data(spark.createDataFrame([(1, one * times)], "doc_id long, text string")).collect()
    places = [("local_phone", "030 1234567"), ("email", "030-1234567@b.cc"), ("phone", "+49 30 1234567")]
    expected = [(kind, i * len(one) + one.index(what), i * len(one) + one.index(what) + len(what)) for i in range(times) for kind, what in places]
    assert [(s.kind, s.start, s.end) for s in row.spans] == expected


def test_added_kinds_need_checksum_or_context(spark):
    text = "IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32 not DE89370400440532013001. ssn: 123-45-6789; 223-45-6789"
    (row,) = find_personal_data(table(spark, [text]).limit(1).withColumn("spans", F.lit(1))).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "123-45-6789"]
    assert row.base_spans == []


@pytest.mark.parametrize("seed", [3, 4])
def test_measurements(spark, seed):
    docs = table(spark, texts(300, seed, most=80), ["the cat sat " * 30_000, "one two three", "one two three"])
    for row in ledger(docs.withColumn("n_lines", F.lit("x"))).collect():
        found = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert found == brute.quality(row.text), row.text


def test_policies_and_ablations_from_the_ledger(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    docs = table(spark, [], [clean, clean.replace("word", "#*"), "few words", None])
    judged = ledger(docs).withColumns({f"v{p.version}": verdict(p) for p in POLICIES})
    assert [(r.v1, r.v2) for r in judged.orderBy("doc_id").collect()] == [(True, True)] + [(True, False)] + [(False, False)] * 2 + [(False, False)] * 0
    effects = {r.rule: (r.failing, r.only_by_it) for r in ablations(judged, POLICIES[-1]).collect()}
    assert effects["few_words"] == (2, 2) and effects["symbols"] == (1, 1)
    assert Policy(9, ("few_words",)).mask == 1 << list(RULES).index("few_words")
    assert ablations(judged.where("false"), POLICIES[0]).collect() == []
