"""Operators that compare rows: line dedup, near-dedup, decontamination, quotes, URLs, mixing, toxicity."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm.decontamination import contaminated
from millrace.llm.line_dedup import drop_boilerplate
from millrace.llm.mixing import frame_slots, integer_weights, mix, plan
from millrace.llm.near_dup import near_duplicates
from millrace.llm.quotes import link_quotes
from millrace.llm.toxicity import fit, score_toxicity
from millrace.llm.url_filter import judge_urls, url_host, url_path

from . import brute


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- line dedup


def test_boilerplate_goes_where_its_site_repeats_it(spark):
    pages = [("a", f"Menu\ncontent {i}\n\n Menu ") for i in range(10)] + [("b", "Menu\nelsewhere")] + [("a", None), (None, "Menu"), ("a", "")]
    pages += [("a", "Menu"), ("a", "Menu")]
    docs = frame(spark, [(i, s, t) for i, (s, t) in enumerate(pages)], "doc_id long, source string, text string")
    rows = drop_boilerplate(docs.withColumn("n", F.lit("x")), dropped="n").orderBy("doc_id").collect()
    assert [r.text for r in rows[:2]] == ["content 0\n", "content 1\n"]
    assert [r.text for r in rows[10:]] == ["Menu\nelsewhere", None, "Menu", "", "", ""]
    assert [r.n for r in rows[9:]] == [2, 0, 0, 0, 0, 1, 1]


def test_line_dedup_of_small_sites_and_of_nothing(spark):
    docs = frame(spark, [(i, "a", "Menu\nx") for i in range(4)], "doc_id long, source string, text string")
    assert {r.text for r in drop_boilerplate(docs).collect()} == {"Menu\nx"}
    assert drop_boilerplate(docs.where("false")).collect() == []


# --- near-dedup


def near_texts(seed):
    pick = random.Random(seed)
    base = [pick.choice("abcdefghij") * 2 + str(i) for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(pick.randint(0, 7)):
            words[pick.randrange(60)] = pick.choice("abcdefgh") * 3
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(pick.choice("abc") for _ in range(pick.randint(0, 9)))) for i in range(40)]
    rows += [(300 + i, " ".join(f"w{pick.randrange(400)}" for _ in range(50))) for i in range(20)]
    return rows + [(None, "x y z"), (None, "X y z"), (None, None), (5, None), (6, ""), (400, "x  Y z"), (401, "x"), (7, "q r s t"), (7, "q r s t")]


@pytest.mark.parametrize("size", [2, 5])
def test_components_as_all_pairs_give_them(spark, size):
    rows = near_texts(size)
    found = near_duplicates(frame(spark, rows).withColumn("n", F.lit("x")), shingle=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute.components(rows, size)


def test_near_dedup_of_nothing_and_of_one_long_text(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    (row,) = near_duplicates(frame(spark, [(1, " ".join(map(str, range(100_000))))])).collect()
    assert (row.n_shingles, row.component_id, row.kept) == (99_996, 1, True)


# --- decontamination


def test_hits_as_windows_give_them(spark):
    pick = random.Random(1)
    say = lambda n: " ".join(pick.choice("a b C d é".split()) for _ in range(n))
    docs = [(i, say(pick.randint(0, 60))) for i in range(150)] + [(1, "a b"), (1, None), (1, None), (None, "a b c d a b c d a b c"), (9, "a-b" * 9000)]
    items = [(i, say(pick.randint(8, 14))) for i in range(12)] + [(50, "a é é"), (None, "d d d d"), (51, None), (52, "--"), (53, "a é é")]
    wanted = brute.windows(items)
    found = contaminated(frame(spark, docs).withColumn("item", F.lit(1)), frame(spark, items, "item_id long, text string")).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found)
    expected = Counter((i, n, h, tuple(s)) for i, t in docs for n, h, s in [brute.hits(t, wanted)])
    assert got == expected


def test_long_texts_of_shared_words(spark):
    words = [f"w{i}" for i in range(30_000)]
    items = [(1, " ".join(words)), (2, "short one"), (3, " ".join(words[100:140]))]
    cut = [w if i % 1000 else "cut" for i, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(cut)), (3, " ".join(words[::2])), (4, " ".join(words[50:90]))]
    wanted = brute.windows(items)
    found = contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in found}
    assert got == {i: (n, h, tuple(s)) for i, t in docs for n, h, s in [brute.hits(t, wanted)]}
    assert got[1][1] == 30_000 and got[2][1] == 29_970 and got[3][1] == 0


def test_no_benchmark_and_no_documents(spark):
    docs, items = frame(spark, [(1, "a b"), (2, None)]), frame(spark, [(1, "a b")], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in contaminated(docs, items.where("false")).collect()) == [(0, 0, []), (2, 0, [])]
    assert contaminated(docs.where("false"), items).collect() == []


# --- quotes

MESSAGES = [
    (1, 0, "Hello there my friends\nhow are you today?"),
    (1, 1, "> Hello there my friends\nI am well thanks, really"),
    (1, 2, "On Monday Bob wrote:\n> I am well   thanks, REALLY\n>> how are you today?\nGood to hear from you\n"),
    (1, 3, ">> how are you today?\nfirst again"),
    (1, 4, "> Good to hear from you\n> first again yes no\ndeep"),
    (2, 0, "> how are you today?\nother"),
    (2, 1, None),
    (2, 2, ""),
    (2, None, "> x"),
    (None, 0, "no thread at all"),
    (None, 1, "> no thread at all\nfine then"),
]


def test_replies_follow_what_they_quote(spark):
    linked = link_quotes(frame(spark, MESSAGES, "conv_id long, turn long, text string").withColumn("depth", F.lit("x")))
    found = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth) for r in linked.collect()}
    assert found[1, 1] == ("I am well thanks, really", 0, 0, 1)
    assert found[1, 2] == ("Good to hear from you", 1, 0, 2)
    assert found[1, 3] == ("first again", 0, 0, 1)
    assert found[1, 4] == ("deep", 2, 0, 3)
    assert found[2, 0] == ("other", None, 0, 0)
    assert found[2, 1] == (None, None, 1, 0) and found[2, 2] == ("", None, 2, 0)
    assert found[2, None] == ("", None, None, 0)
    assert found[None, 1] == ("fine then", 0, 0, 1)


def test_long_chains_and_repeated_messages(spark):
    chain = [(1, i, (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(70)]
    linked = link_quotes(frame(spark, chain + chain[:3] + [(2, 0, "> " * 5000 + "deep")], "conv_id long, turn long, text string"))
    rows = [r for r in linked.collect() if r.conv_id == 1]
    assert len(rows) == 73 and all((r.root_turn, r.depth) == (0, r.turn) for r in rows)
    assert link_quotes(linked.select("conv_id", "turn", "text").where("false")).collect() == []


# --- URLs

RULES = (("allow", "com/"), ("block", "bad.com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"))


def test_host_and_path(spark):
    urls = ["http://A.b/c?d", "x://É.com#/e", "y://h", "no host", None, "a://b://c/d", "q://U@h:80/p/\n/r?s"]
    rows = frame(spark, [(u,) for u in urls], "url string").select(url_host(F.col("url")), url_path(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [("a.b", "/c"), ("É.com", ""), ("h", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("U@h:80".lower(), "/p/\n/r")]


def test_rules_then_links(spark):
    link = '<a class="x" HREF="//{}/p">t</a>'
    pages = [
        (1, "http://good.com/", link.format("friend.org") * 2),
        (2, "http://friend.org/", link.format("friend.org")),
        (3, "http://farm.org/x", link.format("bad.com") + link.format("Sub.Bad.com")),
        (4, "http://sub.bad.com/", None),
        (5, "http://www.example.com/en/1", ""),
        (6, "http://m.example.com/en/1", ""),
        (7, "http://good.com", ""),
        (8, "http://notcom/", ""),
        (9, None, None),
        (9, None, None),
    ]
    judged = judge_urls(frame(spark, pages, "page_id long, url string, html string").withColumn("rule", F.lit(1)), RULES)
    found = [(r.page_id, r.rule, r.verdict) for r in judged.orderBy("page_id").collect()]
    assert found == [
        (1, "com/", "allow"), (2, None, "allow"), (3, None, "block"), (4, "bad.com/", "block"), (5, "www.example.com/en/", "allow"),
        (6, "example.com/en/", "block"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (9, None, "allow"),
    ]
    assert judge_urls(frame(spark, [], "url string, html string"), RULES).collect() == []


def test_distrust_arrives_however_long_the_chain_and_in_circles(spark):
    link = '<a href="//{}/p">t</a>'.format
    hosts = [f"h{i}.org" for i in range(16)]
    chain = [(f"http://{h}/", link(to)) for h, to in zip(hosts, [*hosts[1:], "bad.com"])] + [("http://bad.com/", "")]
    circle = [("http://a.net/", link("b.net")), ("http://b.net/", link("a.net") + link("good.com")), ("http://good.com/", link("a.net"))]
    rows = [(i, *p) for i, p in enumerate(chain + circle)]
    judged = {r.host: r.verdict for r in judge_urls(frame(spark, rows, "page_id long, url string, html string"), RULES).collect()}
    assert {h for h, v in judged.items() if v == "block"} == {*hosts, "bad.com"}


def test_inner_names_may_be_columns(spark):
    extra = {n: F.lit(n) for n in ("match", "Bad_Host", "score", "_host", "a", "b", "x", "evidence", "lines", "kept_lines", "_group", "_number", "c0", "_hash")}
    docs = frame(spark, [(i, "http://h/", "a b c", "s") for i in range(6)], "doc_id long, url string, text string, source string").withColumns(extra)
    results = [
        judge_urls(docs, RULES, html="text"), drop_boilerplate(docs), mix(docs),
        score_toxicity(docs, fit(docs, docs.select("doc_id", F.lit(1).alias("toxic"))), score="s"),
    ]
    for found in results:
        row = found.first().asDict()
        assert found.count() == 6 and all(row[n] == n for n in extra)


# --- mixing


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1.7, "d": 0.3}, {"a": 1, "b": 1e-9}, {chr(97 + i): 2**-i for i in range(12)}])
def test_every_prefix_is_less_than_one_block_off(weights):
    whole = integer_weights(weights)
    size = sum(whole.values())
    count = Counter()
    for t, s in enumerate(frame_slots(whole), 1):
        count[s] += 1
        assert all(abs(count[x] * size - whole[x] * t) < size for x in whole)
    assert dict(count) == whole


@pytest.mark.parametrize("n", [440, 460, 480, 500])
def test_many_sources_of_falling_size_are_planned_whole(n):
    sizes = {f"s{i}": 1 + 4_000_000 // (i + 1) ** 2 for i in range(n)}
    whole = integer_weights(sizes)
    assert min(whole.values()) >= 1 and sum(whole.values()) == 1000
    blocks = {s: -(-k // 4000) for s, k in sizes.items()}
    phases, frames = plan({s: k**0.5 for s, k in sizes.items()}, blocks)
    slot = {(p, s, i): x for p, s, i, x in frames}
    taken = [at + (j - first) // w * size + slot[p, s, (j - first) % w] for s, first, end, w, p, at, size in phases for j in range(first, end)]
    assert sorted(taken) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("n", [460, 501])
def test_a_mix_of_many_sources_of_falling_size_is_whole(spark, n):
    rows = [(k, f"s{i}") for i in range(n) for k in range(1 + 2000 // (i + 1) ** 2)]
    found = mix(frame(spark, rows, "doc_id long, source string")).collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter(rows) and len({r.position for r in found}) == len(rows)


def test_one_more_source_does_not_change_how_the_others_are_mixed(spark):
    """The 502nd source once changed the method of all small ones."""
    rows = [(i, "large") for i in range(6000)] + [(10_000 + i, f"s{i % 500}") for i in range(2000)]
    order = []
    for more in ([], [(20_000 + i, "one more") for i in range(4)]):
        found = mix(frame(spark, rows + more, "doc_id long, source string")).orderBy("position").collect()
        assert Counter((r.doc_id, r.source) for r in found) == Counter(rows + more)
        order.append([r.doc_id for r in found if r.source.startswith("s")])
    assert order[0] == order[1]


def test_plan_places_every_block_once():
    blocks = {"a": 700, "b": 41, "c": 3, "d": 0}
    phases, frames = plan({"a": 1.0, "b": 1.0, "c": 4.0, "d": 1.0}, blocks, 50)
    slot = {(p, s, i): x for p, s, i, x in frames}
    taken = [at + (j - first) // w * size + slot[p, s, (j - first) % w] for s, first, end, w, p, at, size in phases for j in range(first, end)]
    assert sorted(taken) == list(range(744))


def test_mix_keeps_all_rows_and_shares(spark):
    pick = random.Random(5)
    rows = [(i, pick.choice("aaaabbc")) for i in range(4000)] + [(None, None), (7, "a"), (7, "a")]
    mixed = mix(frame(spark, rows, "doc_id long, source string").withColumn("slot", F.lit("x")), {"a": 1, "b": 1, "*": 2}, block=4)
    found = mixed.orderBy("position").collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter(rows) and len({r.position for r in found}) == len(rows)
    count = Counter()
    for t, r in enumerate(found[:1000], 1):
        count[r.source] += 1
        assert all(abs(count[s] - t * w) < 8 for s, w in (("a", 0.25), ("b", 0.25), ("c", 0.5)))
    assert mix(frame(spark, [], "doc_id long, source string")).collect() == []


def test_sources_without_a_weight_are_refused(spark):
    with pytest.raises(ValueError, match="without a weight"):
        mix(frame(spark, [(1, "a"), (2, "b")], "doc_id long, source string"), {"a": 1.0})


# --- toxicity


def test_toxic_words_in_their_variants_are_told_from_ordinary_ones(spark):
    pick = random.Random(6)
    plain = ["".join(pick.choice("aeioustrnl") for _ in range(pick.randint(2, 9))) for _ in range(300)]

    def text(toxic):
        words = [pick.choice(plain) for _ in range(pick.randint(20, 200))]
        for _ in range(1 + len(words) // 15 if toxic else 0):
            words[pick.randrange(len(words))] = pick.choice(["Blorg", "zagfuk" + pick.choice(plain)])
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(1500)]
    docs = frame(spark, [r[:2] for r in rows] + [(None, None), (5000, ""), (5001, None), (5001, None)])
    labels = frame(spark, [(r[0], r[2]) for r in rows[:900]] + [(1, 0), (None, 1), (899, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    scored = {r.doc_id: r.score for r in score_toxicity(docs.withColumn("score", F.lit("x")), model).collect()}
    right = sum((scored[i] >= 0.5) == bool(y) for i, _, y in rows[900:])
    assert right >= 0.97 * 600 and all(0 <= s <= 1 for s in scored.values()) and scored[5000] < 0.5
    nothing = fit(docs, labels.where("false"))
    assert len({r.score for r in score_toxicity(docs, nothing).collect()}) == 1
    assert score_toxicity(docs.where("false"), nothing).collect() == []
