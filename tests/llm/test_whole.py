"""Cases that the operators' first versions left out, against plain versions of the whole definitions."""

from __future__ import annotations

import collections
import random
import re

import pytest
from axisgrove.llm import components, op1_decontaminate, op4_mix, op7_license
from test_brute import norm

# 1


def whole_leaks(docs, items):
    """Windows of the item's length; a shorter document is one window, an item of under 5 words one shingle."""
    out = {}
    for i, t in items:
        w = norm(t)
        n = min(len(w), 5)
        cut = lambda v: [tuple(v[k : k + n]) for k in range(len(v) - n + 1)]
        c = collections.Counter(cut(w)) if w else {}
        m = sum(c.values())
        for d, text in docs:
            s = cut(norm(text)) if w else []
            for b in range(max(1, len(s) - m + 1)):
                x = collections.Counter(s[b : b + m])
                both = sum((x & c).values()) if w else 0
                if both and 100 * both >= 80 * (m + sum(x.values()) - both):
                    out[d, i] = max(out.get((d, i), 0), both / (m + sum(x.values()) - both))
    return out


def check_op1(spark, docs, items):
    got = op1_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {k: round(v, 9) for k, v in whole_leaks(docs, items).items()}
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == want
    return want


def test_op1_documents_shorter_than_the_item(spark):
    w = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(w[:-1])), (2, " ".join(w[5:])), (3, " ".join(w[:30] + w[31:])), (4, " ".join(w[:40])), (5, "w1 w2"), (6, "")]
    assert check_op1(spark, docs, [(1, " ".join(w))]).keys() == {(1, 1), (2, 1), (3, 1)}


def test_op1_short_items(spark):
    docs = [(1, "so one two three it is, and more of it"), (2, "one two"), (3, "three two one and one, three"), (4, "The ONE, two Three four!"), (5, "x"), (6, None)]
    items = [(1, "one two three"), (2, "one"), (3, "three four"), (4, "one two three four"), (5, ""), (6, "one two three four five")]
    assert (1, 1) in check_op1(spark, docs, items)


def test_op1_random_short_documents(spark):
    rng = random.Random(31)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60])))) for i in range(24)]
    docs = []
    for d in range(150):
        p = rng.choice(items)[1].split()
        p = p[rng.randint(0, 4) : len(p) - rng.randint(0, 4)]
        docs.append((d, " ".join(p + [rng.choice("xyz") for _ in range(rng.choice([0, 0, 1, 9]))])))
    assert len(check_op1(spark, docs, items)) > 20


# 7


def best_windows(text):
    """The best Dice of all runs of words with at most 1.5 times the template's bigrams, for each template."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    g, out = [f"{a} {b}" for a, b in zip(w, w[1:])], {}
    for name, template in op7_license.TEMPLATES.items():
        t = set(op7_license.bigrams(template))
        for a in range(len(g)):
            seen, both = set(), 0
            for x in g[a : a + len(t) * 3 // 2]:
                both += x in t and x not in seen
                seen.add(x)
                out[name] = max(out.get(name, 0), 2 * both / (len(t) + len(seen)))
    return {k: v for k, v in out.items() if v >= op7_license.LEAST}


def test_op7_licences_inside_longer_texts(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(["of the", "software", "a", "river", "is", "the license", "without", "warranty", "stone"]) for _ in range(n))
    texts = []
    for name, template in op7_license.TEMPLATES.items():
        w = template.split()
        k = len(w) // 3
        texts.append("\n\n".join([" ".join(w[:k]), " ".join(w[k : 2 * k]), " ".join(w[2 * k :]), prose(500)]))
        texts.append(f"{prose(40)} {template} {prose(40)}")
        for _ in range(2):
            v = [x for x in w if rng.random() > 0.05]
            v[rng.randrange(len(v)) : 0] = prose(rng.randint(0, 3)).split()
            texts.append(prose(30) + "\n" + " ".join(v) + "\n\n" + prose(9))
        texts.append(" ".join(w[: 1 + len(w) // 2] * 3 + w))
    rows = op7_license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = best_windows(texts[r.doc_id])
        assert set(want) <= set(r.licenses.split(",")) and r.n_matches >= len(want)
        if want:
            assert r.dice >= max(want.values()) - 1e-12
        if r.doc_id % 5 < 2:
            assert list(op7_license.TEMPLATES)[r.doc_id // 5] in r.licenses.split(",") and r.dice == 1
            # no unit of these texts matches more than the windows do
            assert r.licenses == ",".join(k for k in op7_license.TEMPLATES if k in want)


# 8


def test_components_never_stop_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components.connected_components(edges, rounds=1)
    assert {r.component for r in components.connected_components(edges).collect()} == {0}


# null ids


def test_null_ids_leak_and_are_mixed(spark, odd):
    items = spark.createDataFrame([(1, "no id at all here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in op1_decontaminate.contaminated(odd, items).collect()] == [(None, 1)]
    left = op1_decontaminate.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 1 and left.where("doc_id is null").count() == 0
    d = odd.dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.copies for r in op4_mix.mix(d).collect()}
    got = collections.Counter(r.doc_id for r in op4_mix.mixed(d).collect())
    assert got == collections.Counter({k: n for k, n in plan.items() if n}) and got[None] > 0


def test_op1_repeated_shingles_beyond_the_radius(spark):
    docs, items = [], []
    for k in range(60):
        w = [f"i{k}w{j}" for j in range(204)]
        w[90:104] = [f"r{k}"] * 14
        items.append((k, " ".join(w)))
        w[90:104] = [f"x{k}y{j}" for j in range(14)]
        docs.append((k, " ".join(w)))
    assert len(check_op1(spark, docs, items)) == 60
