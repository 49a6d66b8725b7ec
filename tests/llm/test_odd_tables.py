"""Each operator's defined results for odd rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from axisgrove.llm import op1_decontaminate, op2_pii, op3_html, op4_mix, op5_rules, op6_quality, op7_license, op8_minhash, op9_lm, op10_language


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "x") for i in range(20)] + [(None, 1, 0, "")], "doc_id long, quality int, toxic int, text string")


def items(spark, n=3):
    return spark.createDataFrame([(1, "some item of the benchmark that nobody has", "x"), (2, None, "y"), (3, "", "z")][:n], "item_id long, text string, key string")


OPERATORS = {
    "op1": lambda s, d: op1_decontaminate.contaminated(d, items(s)),
    "op2": lambda s, d: op2_pii.digest(op2_pii.find(d)),
    "op4": lambda s, d: op4_mix.mix(d),
    "op5": lambda s, d: op5_rules.cascade(d),
    "op6": lambda s, d: op6_quality.classify(d, op6_quality.fit(d, labels(s))),
    "op7": lambda s, d: op7_license.scan(d),
    "op8": lambda s, d: op8_minhash.near_duplicates(d),
    "op9": lambda s, d: op9_lm.score(d, op9_lm.train(d)),
    "op10": lambda s, d: op10_language.identify(d, op10_language.fit(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    if name == "op1":
        assert got == []
    else:
        assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    if name == "op2":
        assert by[0]["spans"] == by[1]["spans"] == "" and by[0]["base_sha256"].startswith("e3b0c442")
    if name == "op4":
        assert by[0]["size"] == by[1]["size"] == by[2]["size"] == 0 and all(r["copies"] <= 2 for r in got)
    if name == "op5":
        assert [by[i]["n_words"] for i in (0, 1, 2, 3, 5)] == [0, 0, 0, 1, 30000] and by[0]["base_failed"] and not by[0]["kept"]
        assert by[21 - 1]["n_dup_lines"] == 29
    if name in ("op6", "op10"):
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "op8":
        assert [by[i]["n_shingles"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
        assert by[0]["kept"] and by[8]["component_id"] == by[11]["component_id"] == 8 and not by[9]["kept"]
    if name == "op9":
        assert by[0]["n_tokens"] == by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[3]["n_tokens"] == 2
        assert all(r["perplexity"] >= 1 for r in got)
    if name == "op10":
        assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[7]["lang_pred"] == "und" and by[5]["lang_pred"] != "und"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def test_stages_keep_columns_and_rows(spark, odd):
    """The pipeline's forms of the operators on the odd table."""
    for out in (op1_decontaminate.clean(odd, items(spark)), op2_pii.redacted(odd), op8_minhash.deduplicated(odd), op6_quality.accepted(odd, op6_quality.fit(odd, labels(spark)))):
        assert out.columns == odd.columns
    assert op1_decontaminate.clean(odd, items(spark, 0)).count() == odd.count()
    left = op8_minhash.deduplicated(odd)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in odd.collect()} - {9, 10, 11}
    m = op4_mix.mixed(odd.dropDuplicates(["doc_id"]))
    assert {"copy", "shard", "order_key", "text"} <= set(m.columns) and len(set(m.columns)) == len(m.columns) and m.count() > 0


def test_stages_on_an_empty_table(spark, empty):
    for out in (op1_decontaminate.clean(empty, items(spark)), op2_pii.redacted(empty), op8_minhash.deduplicated(empty), op6_quality.accepted(empty, op6_quality.fit(empty, labels(spark))), op4_mix.mixed(empty)):
        assert out.collect() == []


def test_no_labels(spark, odd):
    m = op6_quality.fit(odd, labels(spark).limit(0))
    assert {r.score for r in op6_quality.classify(odd, m).collect()} == {1.0}


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>" * 3000 + "deep text here"), (4, "u", "<script>x"), (5, "u", "no markup at all &amp; so on"), (5, "u", "<!--"), (6, "u", "< b >&lt;")], "page_id long, url string, html string")
    got = op3_html.extract(pages).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id in (1, 2, 4)] == ["", "", ""] and all(r.n_chars == len(r.text) for r in got)
    assert op3_html.extract(pages.limit(0)).collect() == []
