"""What the second review found missing."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.mixing import mix
from millrace.llm.quotes import link_quotes
from millrace.llm.toxicity import SEEN, class_models

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


# --- line dedup before near-dedup


@pytest.mark.parametrize("changed", [0, 1])
def test_one_document_of_a_large_group_of_copies_keeps_its_text(spark, changed):
    pick = random.Random(11)
    say = lambda n: " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    lines = [say(12) for _ in range(8)]
    copies = []
    for i in range(40):
        copy = list(lines)
        if changed and i % 2:
            copy[i % 8] = copy[i % 8].replace("w", "v", 1)
        copies.append("\n".join(copy))
    texts = copies + [f"Menu of the site\n{say(12)}" for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    cleaned = corpus_pipeline.remove_boilerplate_lines(spark, docs, "")
    left = [r.text for r in corpus_pipeline.keep_one_of_near_copies(spark, cleaned, "").collect()]
    assert left.count(copies[0]) == 1
    assert "" not in left and not any("Menu" in t for t in left)
    assert all(t.split("\n")[1] in left for t in texts[40:])
    if not changed:
        assert len(left) == 81


# --- mixing


def test_any_number_of_sources_makes_a_whole_mix(spark):
    rows = [(i, f"s{i % 600}") for i in range(12_000)] + [(20_000 + i, f"t{i}") for i in range(300)]
    rows += [(30_000 + i, "large") for i in range(9000)] + [(None, None), (7, None)]
    found = mix(spark.createDataFrame(rows, "doc_id long, source string")).orderBy("position").collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter(rows) and len({r.position for r in found}) == len(rows)
    weights = {s: n**0.5 for s, n in Counter(s for _, s in rows).items()}
    whole, seen = sum(weights.values()), Counter()
    for t, r in enumerate(found[:9000], 1):
        seen[r.source] += 1
        assert abs(seen["large"] - t * weights["large"] / whole) < 8 + t / 1000
        if t % 500 == 0:
            assert all(abs(seen[f"s{i}"] - t * weights["s0"] / whole) < 2.5 for i in range(600))


# --- quotes


def test_short_wrapped_and_cut_quotations_are_linked(spark):
    said = "The train to the coast leaves at nine from the old station\nand we will need about two hours to get there with the luggage"
    messages = [
        (1, 0, "Are you coming along tomorrow?"),
        (1, 1, "> Are you coming along tomorrow?\nYes."),
        (1, 2, "> Yes.\nThanks!"),
        (1, 3, ">Thanks!\n:)"),
        (1, 4, "> :)\nbye"),
        (2, 0, said + "\n\nRegards"),
        (2, 1, "> The train to the coast leaves\n> at nine from the old station and we will\n> need about two hours to get there with the luggage\n>\n> Regards\ngood"),
        (2, 2, "> " + said.replace("\n", " ") + "\nfine"),
        (2, 3, "> at nine from the old\n> station and we will need about\n> two\nright"),
        (2, 4, "> nothing that anybody here has ever said before\nwhat?"),
    ]
    found = {(r.conv_id, r.turn): (r.parent_turn, r.depth) for r in link_quotes(spark.createDataFrame(messages, "conv_id long, turn long, text string")).collect()}
    assert [found[1, i] for i in range(5)] == [(None, 0), (0, 1), (1, 2), (2, 3), (3, 4)]
    assert [found[2, i] for i in range(5)] == [(None, 0), (0, 1), (0, 1), (0, 1), (None, 0)]


# --- toxicity


def test_rare_spellings_count_in_any_size_of_corpus(spark):
    rare = " ".join(["zagfuk"] * SEEN)
    # 8.4 million letters: under a bar of 2^-20 of all, a pair would need nine sightings.
    common = " ".join(["ordinary"] * 40_000)
    rows = [(rare, 1)] + [(common, i % 2) for i in range(24)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    ratios = [r.ratio for r in class_models(labelled).collect()]
    assert len(ratios) == len("zagfuk") + len("ordinary") + 2 and sum(ratios) > 0


# --- what the pipeline may drop


def near_copies(n, seed=3):
    pick = random.Random(seed)
    base = [f"w{pick.randrange(10**6)}" for _ in range(60)]
    copies = []
    for i in range(n):
        words = list(base)
        words[i % 60] = f"v{i}"
        copies.append(" ".join(words))
    return copies


def test_near_copies_without_ids_or_with_shared_ids_are_one(spark):
    copies = near_copies(20)
    other = " ".join(f"x{i}" for i in range(40))
    rows = [(None, t) for t in copies] + [(7, other), (8, None), (8, None), (None, "")]
    left = lambda rows: corpus_pipeline.keep_one_of_near_copies(
        spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), ""
    ).collect()
    found = left(rows)
    assert sum(r.text in copies for r in found) == 1
    assert sorted((r.doc_id or 0, r.text or "") for r in found if r.text not in copies) == [(0, ""), (7, other), (8, "")]
    found = left([(1, copies[0]), (1, copies[1]), (2, copies[2]), (None, copies[3])])
    assert len(found) == 1 and found[0].doc_id == 1


def test_an_item_of_few_words_drops_no_document(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(12))
    spark.createDataFrame([("a", "yes"), ("b", "nine words are not enough for a window here"), ("c", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["well yes", "so nine words are not enough for a window here", f"see {passage[:-4]} there", "clean"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.remove_contaminated(spark, docs, str(tmp_path)).collect()) == [0, 1, 3]
