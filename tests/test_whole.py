"""Registered queries read all of their relations."""

from sylva import corpus
from sylva.functions import text
from sylva.langs import KINDS, LANGUAGES, PRESETS
from sylva.operators import metrics
from sylva.plans import registry


def test_whole_pages_are_escaped(spark, sf):
    odd = "\t\n\r\x01\\\""
    pages = {r.page_id: r.html + odd for r in corpus.relation(spark, sf, "pages").collect()}
    assert max(map(len, pages.values())) > 10_000
    assert {r.page_id: f'"{r.s}"' for r in registry.QUERIES["json_escape"](spark, sf).collect()} == {k: text.json_string(v) for k, v in pages.items()}
    for r in registry.QUERIES["xml_escape"](spark, sf).collect():
        assert (r.attribute, r.content) == (text.xml_escape(pages[r.page_id], True), text.xml_escape(pages[r.page_id]))


def test_all_orders_give_links(spark, sf):
    lines = corpus.relation(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()
    files = {r.pk: r.file_id for r in corpus.relation(spark, sf, "files").collect()}
    refs = {(files[r.l_partkey], f"sym_{(r.l_partkey * 11 + r.l_suppkey) % 5003}") for r in lines if r.l_partkey in files}
    orders: dict = {}
    for r in sorted(lines, key=lambda r: (r.l_linenumber, r.l_partkey, r.l_suppkey)):
        orders.setdefault(r.l_orderkey, []).append(r.l_partkey)
    adjacent = {p for parts in orders.values() for p in zip(parts, parts[1:])}
    get = lambda name: [tuple(r) for r in corpus.relation(spark, sf, name).collect()]
    assert sorted(get("refs")) == sorted(refs) and sorted(get("adjacent")) == sorted(adjacent)


def test_no_registered_query_takes_a_part_of_a_relation():
    every = " ".join([*corpus.RECIPES.values(), *registry.ORACLES.values()])
    assert "l_orderkey %" not in every and "substr(html" not in every and not any(n.endswith("_whole") for n in registry.QUERIES)


def test_answers_are_sought_in_every_map(spark, sf):
    questions = spark.createDataFrame([(1, "any", ["b", "z"]), (2, "all", ["b", "z"]), (3, "all", ["b", "c"])], "id long, match string, expect array<string>")
    maps = spark.createDataFrame([(7, "a b c"), (9, "x z"), (12345, "b z")], "map_id long, text string")
    got = {(r.id, r.map_id) for r in metrics.answer_coverage(questions, maps).collect() if r.covered}
    assert got == {(1, 7), (1, 9), (1, 12345), (2, 12345), (3, 7)}
    whole = registry.QUERIES["answer_coverage"](spark, sf).collect()
    asked = corpus.relation(spark, sf, "conversations").filter("turn = 0").count()
    assert {r.map_id for r in whole} == set(PRESETS) and len(whole) == asked * len(PRESETS)


def test_symbols_of_every_language_and_kind_are_extracted(spark, sf):
    got = registry.QUERIES["extract_symbols"](spark, sf).join(corpus.relation(spark, sf, "files").select("file_id", "lang"), "file_id").collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.lang, set()).add(r.kind)
    assert set(kinds) == set(LANGUAGES) and {"class", "field"} <= set.intersection(*kinds.values())
    assert "method" in kinds["java"] and set().union(*kinds.values()) == set(KINDS)
    assert sum(r.name != "Holder" for r in got) == corpus.relation(spark, sf, "symbols").count()
