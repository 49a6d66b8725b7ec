"""Faults of the first round, each with a case that showed it."""

from __future__ import annotations

import collections
import math
import os
import random
import time
import zlib

import numpy as np
import pytest
from axisgrove.llm import common, components, op1_decontaminate, op2_pii, op3_html, op4_mix, op5_rules, op6_quality, op7_license, op8_minhash, op9_lm, op10_language
from checks import same
from pyspark.sql import functions as F
from test_brute import SF, base_spans

# 2


def test_op2_redaction_leaves_no_span(spark):
    rng = random.Random(22)
    parts = ["1.2.3.4", "4111111111111111", ".5.6.5.6", " ", " ", "71.2.3.4", "+1 (377) 555-0271", "a@b.c", "@x.y", "9807 9157 6280 4490", "7", ".", "-", "+", "joe (at) mail (dot) org", "key = \"ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e\"", "123-45-6789"]
    texts = ["71.2.3.4 4111111111111111.5.6.5.6"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)] + [None, "", "no data"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = op2_pii.redacted(d).collect()
    assert out[0].text == "[ip] [card][ip]" or base_spans(out[0].text) == ""
    assert [r.text for r in out if r.text and base_spans(r.text)] == []
    assert [r.text for r in out[-3:]] == [None, "", "no data"]


def test_op2_assigned_secrets_of_any_length(spark):
    texts = [f'set password = "hunter{i}pass" now' for i in range(30)] + [f"pwd=x{i}y7 and more" for i in range(30)] + [f'token: "{"qwertzui" * 40}{i}"' for i in range(9)] + ["the key: a plain word of 2024", "no key here", 'secret = "correcthorse"']
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in op2_pii.redacted(d).collect()]
    assert all("hunter" not in t for t in out[:30]) and all("y7" not in t for t in out[30:60]) and all("qwertz" not in t for t in out[60:69])
    assert out[0] == 'set password = "[assigned]" now' and out[69:71] == texts[69:71] and "correcthorse" not in out[71]


# 6, 10


def test_samples_never_come_out_empty(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2990, 'a', 'b') as l")
    got = common.sampled(rows, "id", 5, "l").groupBy("l").count().collect()
    assert {r.l for r in got} == {"a", "b"} and all(1 <= r["count"] <= 5 for r in got)
    # a language with one id only, however often, is learned
    d = spark.createDataFrame([(1, "zut alors mon ami", "fr")] * 500 + [(i, f"the thing number {chr(97 + i % 26)} is here", "en") for i in range(2, 900)], "doc_id long, text string, lang string")
    assert op10_language.fit(d, per_lang=3, held=9).langs == ["en", "fr"]


def test_op6_conflicting_labels_are_left_out(spark):
    d = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 2)) for i in range(40)], "doc_id long, text string")
    good = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    clash = good.unionByName(good.where("doc_id < 10").selectExpr("doc_id", "1 - quality as quality"))
    a, b = (op6_quality.classify(d, op6_quality.fit(d, x)).orderBy("doc_id").collect() for x in (good.where("doc_id >= 10"), clash))
    assert a == b


def crc_fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op6_is_the_discriminant(spark):
    """The query against the formula, from the statistics of each text."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs}

    def stats(t):
        b = (t or "").encode()
        return op6_quality.statistics(np.frombuffer(b, dtype=np.uint8), np.array([0, len(b)]))[0]

    x = {i: stats(t) for i, t in docs.items()}
    ids = sorted(i for i in labels if crc_fold(i, 5) != 0)
    train, y = np.array([x[i] for i in ids]), np.array([labels[i] for i in ids])
    mean, dev = train.mean(axis=0), train.std(axis=0) + 1e-6
    z = (train - mean) / dev
    pooled = np.diag(sum((y == c).mean() * z[y == c].var(axis=0) for c in (0, 1))) + 0.05 * np.eye(z.shape[1])
    density = []
    for c in (0, 1):
        own = z[y == c]
        k = min(0.95, 0.3 + 0.5 * z.shape[1] / len(own))
        cov = (1 - k) * np.cov(own.T, bias=True) + k * pooled
        density.append((own.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log((y == c).mean())))
    rows = op6_quality.op6_quality(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        v = (x[r.doc_id] - mean) / dev
        lp = [p - 0.5 * ((v - m) @ inv @ (v - m)) - 0.5 * det for m, inv, det, p in density]
        want = 1 / (1 + np.exp(-np.clip(lp[1] - lp[0], -30, 30)))
        assert abs(r.score - want) < 1e-6 and r.held_out == (crc_fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3)


def test_op10_is_the_nearest_centroid(spark):
    """The query's language and score against dictionaries of n-grams and the model's centroids; folds by zlib."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = op10_language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in op10_language.op10_language(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs[:400]:
        t = r.text or ""
        g = got[r.doc_id]
        assert g.held_out == (crc_fold(r.doc_id, 4) == 2)
        if not any(c.isalpha() for c in t):
            assert g.lang_pred == "und" and g.score == 0
            continue
        b = [32 if c in b" \t\n\x0b\x0c\r0123456789" else c + 32 * (65 <= c <= 90) for c in t.encode()]
        tf = collections.Counter(((x * 40503) % 2**32 + 7) % 4096 for x in b)
        tf.update(((x * 257 + y + 1009) * 2654435761 % 2**32) >> 20 for x, y in zip(b, b[1:]))
        tf.update((((x * 257 + y) * 257 + z + 70001) * 2654435761 % 2**32) >> 20 for x, y, z in zip(b, b[1:], b[2:]))
        v = np.zeros(4096)
        for k, n in tf.items():
            v[k] = math.log1p(n) * model.idf[k]
        cos = model.centroids.astype(float) @ (v / np.linalg.norm(v))
        best = cos.argsort()[::-1]
        assert abs(g.score - min(1, cos[best[0]])) < 1e-4
        if cos[best[0]] - cos[best[1]] > 1e-4:
            assert g.lang_pred == model.langs[model.of[best[0]]]


# 9


def test_op9_lost_files_raise(spark, tmp_path):
    d = spark.createDataFrame([(i, f"a text of {i % 7} words and {i} more") for i in range(50)], "doc_id long, text string")
    model = op9_lm.train(d)
    assert op9_lm.score(d, model).count() == 50
    folder = op9_lm.local(model.root)
    os.remove(f"{folder}/{sorted(model.files)[0]}")
    with pytest.raises(Exception, match="No such file"):
        op9_lm.score(d, model).collect()


def test_op9_files(tmp_path):
    root = f"file://{tmp_path}/x"
    a, b = np.arange(9, dtype=np.uint64), np.arange(8, dtype=np.uint8).reshape(2, 4)
    op9_lm.put(root, "f", a=a, b=b, none=np.zeros(0, dtype=np.uint64))
    got, taken = op9_lm.get(root, "f")
    assert taken == 0 and (got["a"] == a).all() and (got["b"] == b).all() and len(got["none"]) == 0 and os.listdir(tmp_path / "x") == ["f"]
    for k in range(5):
        op9_lm.put(root, f"f{k}", a=a)
    shelf = op9_lm.Shelf(root, frozenset(f"f{k}" for k in range(5)))
    shelf.MAPS = 2
    assert [len(shelf.look(f"f{k}")["a"]) for k in (0, 1, 2, 3, 4, 0)] == [9] * 6 and len(shelf.open) == 2 and shelf.look("g") is None


def test_op9_folds_in_parts(spark, monkeypatch):
    """Sums do not depend on how much is gathered at a time."""
    rng = random.Random(9)
    d = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(60))) for i in range(300)], "doc_id long, text string")
    a = op9_lm.score(d, op9_lm.train(d)).orderBy("doc_id").collect()
    monkeypatch.setattr(op9_lm, "FOLD", 20)
    monkeypatch.setattr(op9_lm, "CHUNK", 500)
    monkeypatch.setattr(op9_lm, "SHARD_BYTES", 1000)
    b = op9_lm.score(d, op9_lm.train(d)).orderBy("doc_id").collect()
    assert all(x.n_known == y.n_known and math.isclose(x.score, y.score, rel_tol=1e-12) for x, y in zip(a, b))


# 3


@pytest.mark.parametrize("name, source", [
    ("open tags", "<a " * 200_000), ("mixed", "<b></i>" * 60_000), ("barrier", "<i><p>" + "<b>" * 60_000 + "</i>" * 60_000), ("headings", "<div>" + "<b>" * 50_000 + "<h1>x" * 50_000),
    ("quotes", "<a '\">" * 60_000), ("one quote", '<a ">' * 59_999), ("deep", "<div>" * 60_000 + "x"), ("comments", "<!-- >" * 60_000), ("scripts", "<script>" * 60_000), ("heads", "<head>" * 60_000),
    ("ends", "</div>" * 100_000), ("references", "&#" * 100_000), ("digits", "&#" + "9" * 50_000 + ";"), ("attributes", "<p " + "class=" * 60_000 + ">"), ("declarations", "<!" * 200_000), ("deep ends", "<ul><li>" * 30_000 + "</p>" * 60_000)])
def test_op3_hostile_pages_are_linear(name, source):
    began = time.perf_counter()
    page = op3_html.Page(source)
    op3_html.decoded(page.parent, page.weights(), np.full(len(page.tag), 0.5))
    assert time.perf_counter() - began < 8, name


def test_op3_the_training_marker_is_an_attribute_like_others(spark):
    html = '<article data-truth="yes"><h1>T</h1><p>Some words of the text here.</p></article>'
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html.replace(' data-truth="yes"', "")), (3, "u", html.replace('"yes"', '"0"'))], "page_id long, url string, html string")
    assert len({r.text for r in op3_html.extract(pages).collect()}) == 1


def test_op3_unclosed_widgets_leave_the_article():
    model = op3_html.fit()
    p = "<p>" + "A sentence of the article that is long enough to be one. " * 4 + "</p>"
    body = f"<article><h1>Title of it</h1>{p}{p}<p>Where <math><mi>x</mi></math> is large, {'it is so and so on. ' * 5}</p>{p}</article><footer>&copy; someone</footer>"
    want = op3_html.main_text("<html><body>" + body.replace("<math><mi>x</mi></math>", "x"), model)
    assert want.startswith("Title of it A sentence") and "someone" not in want
    for start in ('<nav><ul><li><a href=/x>One</a></li><li><button>Menu</li></ul></nav>', '<div class="notice"><select><option>A<option>B</div>', '<nav><svg><a href=/>Home</nav>', ""):
        got = op3_html.main_text("<html><body>" + start + body, model)
        assert got.replace(" ", "") == want.replace(" ", ""), start


# 5


def test_op5_order_is_the_same_in_reruns_and_cheap_rejections_come_first(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = op5_rules.ordered(d), op5_rules.ordered(d.repartition(13))
    assert a == b and {r.name for r, _, _ in a} == {r.name for r in op5_rules.RULES}
    assert sorted(r.first_failed or "" for r in op5_rules.cascade(d).collect()) == sorted(r.first_failed or "" for r in op5_rules.cascade(d.repartition(7)).collect())
    # what each rule costs and rejects, counted anew in the order given
    rows, paid = [r.asDict() for r in op5_rules.measured(d).select("*", *(F.expr(r.fails).alias(f"_{r.name}") for r in op5_rules.RULES)).collect()], set()
    for rule, cost, gone in a:
        needs = [*(m for m in rule.metrics if m not in paid), *rule.work]
        units = [sum(op5_rules.UNITS[x][k] for x in needs) for k in (0, 1)]
        assert math.isclose(cost, 1 + (units[0] * sum(len(r["text"]) for r in rows) + units[1] * sum(r["n_words"] for r in rows)) / len(rows))
        assert math.isclose(gone, sum(r[f"_{rule.name}"] for r in rows) / len(rows))
        rows, paid = [r for r in rows if not r[f"_{rule.name}"]], paid | set(rule.metrics)


def test_op5_passing_is_the_cascade(spark, odd):
    for d in (spark.read.parquet(f"{SF}/documents.parquet"), odd.where("doc_id is not null")):
        kept = [r.doc_id for r in op5_rules.cascade(d).where("kept").collect()]
        got = op5_rules.passing(d)
        assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == sorted(kept) and kept


# 1


def test_op1_a_million_words_that_repeat_an_item(spark):
    rng = random.Random(1)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    long_item = [f"v{rng.randrange(10**6)}" for _ in range(20_000)]
    docs = [(1, " ".join(item * 25_000)), (2, " ".join(["x"] * 50_000 + long_item[:-9] + ["y"] * 9)), (3, "a " * 1_000_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long_item)), (3, "a " * 30)], "item_id long, text string")
    began = time.perf_counter()
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in op1_decontaminate.contaminated(d, items).collect()}
    assert time.perf_counter() - began < 90
    # the window of the long item has room for nine words before the passage
    assert got.keys() == {(1, 1), (2, 2), (3, 3)} and got[1, 1] == (0, 1.0) and got[3, 3] == (0, 1.0) and got[2, 2][0] == 49_991 and got[2, 2][1] > 0.99


def test_op1_first_of_the_best_windows(spark):
    """Starts and similarities of all windows, with shingles that the item and the documents repeat."""
    rng = random.Random(11)
    items = [(i, [rng.choice("abc") for _ in range(rng.choice([6, 9, 14, 30]))]) for i in range(12)]
    docs = []
    for k in range(150):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abz")
        docs.append((k, [rng.choice("abcz") for _ in range(rng.randint(0, 12))] + w + w[: rng.randint(0, 9)]))
    cut = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    want = {}
    for d, text in docs:
        for i, item in items:
            c, s = collections.Counter(cut(item)), cut(text)
            m = sum(c.values())
            for b in range(max(1, len(s) - m + 1)):
                x = collections.Counter(s[b : b + m])
                both, sizes = sum((x & c).values()), m + sum(x.values())
                if 100 * both >= 80 * (sizes - both) and both / (sizes - both) > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (b, both / (sizes - both))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in op1_decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and len(want) > 50


# 8


def test_op8_hot_groups_negative_ids_and_none(spark, monkeypatch):
    """Groups far beyond a block and a salt, with ids of both signs, against all pairs."""
    rng = random.Random(88)
    docs = []
    for g, size in enumerate((150, 90, 3, 2)):
        centre = [f"g{g}w{i}" for i in range(120)]
        for _ in range(size):
            w = list(centre)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8, 12])):
                w[rng.randrange(120)] = f"x{rng.random()}"
            docs.append(" ".join(w))
    docs += [" ".join(f"c{4 * k + i}" for i in range(100)) for k in range(40)]
    rng.shuffle(docs)
    rows = [(i - 140, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, "only here and nowhere else")]
    monkeypatch.setattr(op8_minhash.in_blocks, "__defaults__", (16, 30_000))
    monkeypatch.setattr(common.salted_join, "__defaults__", ("inner", None, 20))
    monkeypatch.setattr(components, "SALTED", 1)
    monkeypatch.setattr(components, "EDGES", 20)
    found = op8_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)] * 2
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows if i is not None for w in [t.split()]}
    best = {i: i for i in sets}

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if j < i else 0
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                best[b] = a
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(got) - 100


def test_salted_join_is_a_join(spark):
    many = spark.range(2000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as v").unionByName(spark.sql("select cast(null as bigint) as k, 7L as v"))
    one = spark.range(0, 40).selectExpr("id as k", "id * 2 as w")
    for how in ("inner", "left", "left_semi"):
        scratch = common.Scratch(spark, "t")
        assert sorted(map(str, common.salted_join(scratch, how, many, one, "k", how, rows=20).collect())) == sorted(map(str, many.join(one, "k", how).collect()))


# 7


def test_op7_runs_of_words_as_sql_finds_them(spark, tmp_path):
    rng = random.Random(77)
    prose = lambda n: " ".join(rng.choice(["of the", "software", "a", "river", "is", "the license", "without", "warranty", "stone"]) for _ in range(n))
    texts = [None, "", "one"]
    for t in op7_license.TEMPLATES.values():
        w = t.split()
        texts += [f"{prose(40)} {t} {prose(40)}", "\n\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), "def f(x):\n    return x\n" * 30])]
        texts.append(prose(9) + "\n# " + "\n# ".join(" ".join(v[i : i + 9]) for v in [[x for x in w if rng.random() > 0.04]] for i in range(0, len(v), 9)) + "\n" + prose(5))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    [made] = (tmp_path / "x").glob("*.parquet")
    made.rename(tmp_path / "documents.parquet")
    same(op7_license.op7_license_scan(spark, str(tmp_path)), op7_license.OP7_SQL, str(tmp_path))
    names = list(op7_license.TEMPLATES)
    for r in op7_license.op7_license_scan(spark, str(tmp_path)).collect():
        # the third text of each licence lacks words, a short notice perhaps too many
        assert r.doc_id < 3 or r.doc_id % 3 == 2 or names[(r.doc_id - 3) // 3] in r.licenses.split(",")


def test_scratch_scope(spark):
    with common.Scratch.scope():
        t = common.Scratch(spark, "scoped")
        assert t.keep(spark.range(3), "a").count() == 3
        where = op9_lm.local(t.root)
        assert os.path.exists(where)
    assert not os.path.exists(where)


def test_op1_same_as_sql(spark):
    same(op1_decontaminate.op1_decontaminate(spark, SF), op1_decontaminate.OP1_SQL, SF)


def test_op1_sql_on_odd_documents(spark, tmp_path):
    """Short items and documents, repeated shingles, rows of one id and without one."""
    rng = random.Random(111)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 30, 40])] + [(90, None), (91, "")]
    docs = [(None if k % 20 == 0 else k // 2, ", ".join(rng.choice(items[:10])[1].split()[rng.randint(0, 2) :] + [rng.choice("abz") for _ in range(rng.randint(0, 6))])) for k in range(160)] + [(999, None)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        [made] = (tmp_path / name).glob("*.parquet")
        made.rename(tmp_path / f"{name}.parquet")
    same(op1_decontaminate.op1_decontaminate(spark, str(tmp_path)), op1_decontaminate.OP1_SQL, str(tmp_path))


# 4


def test_op4_trees_of_many_sources(spark):
    q = spark.createDataFrame([(k, (k * 7) % 23) for k in range(1, 701)], "rank int, q long")
    got = {r["rank"]: list(r["per_shard"]) for r in op4_mix.shard_quotas(q, 3, 9).collect()}
    assert {k: sum(v) for k, v in got.items()} == {k: (k * 7) % 23 for k in range(1, 701)}
    shards = [sum(v[s] for v in got.values()) for s in range(8)]
    assert max(shards) - min(shards) <= 3 * 3
