"""Operators against plain versions of their definitions, SQL, exact truth or held-out labels."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from axisgrove.llm import components, op1_decontaminate, op2_pii, op3_html, op4_mix, op5_rules, op6_quality, op7_license, op8_minhash, op9_lm, op10_language
from checks import same

SF = "/root/testdata/sf0.01"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# 1


def norm(t):
    return re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()


def windows(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def leaks(docs, items):
    """Windows of the item's length; a shorter document is one window, an item of under 5 words one shingle."""
    out = {}
    for i, t in items:
        w = norm(t)
        n = min(len(w), 5)
        cut = lambda v: [tuple(v[k : k + n]) for k in range(len(v) - n + 1)] if len(v) >= n or n < 5 else [tuple(v)] if v else []
        c = collections.Counter(cut(w)) if w else {}
        m = sum(c.values())
        for d, text in docs:
            s = cut(norm(text)) if w else []
            if not set(s) & set(c):
                continue
            for b in range(max(1, len(s) - m + 1)):
                x = collections.Counter(s[b : b + m])
                both = sum((x & c).values())
                if 100 * both >= 80 * (m + sum(x.values()) - both):
                    out[d, i] = max(out.get((d, i), 0), both / (m + sum(x.values()) - both))
    return out


def test_op1_random(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 20, 30, 60])))) for i in range(30)]
    docs = []
    for d in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if d % 2:
            p = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                p[rng.randrange(len(p))] = "zz"
            if d % 3 == 0:
                p = p[rng.randint(0, 3) : len(p) - rng.randint(0, 2)]
            k = rng.randint(0, len(w))
            w[k:k] = p
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else ", ".join(w)))
    got = op1_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in leaks(docs, items).items()}


def test_op1_table(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in op1_decontaminate.op1_decontaminate(spark, SF).collect()}
    assert got == set(leaks(docs, items)) and got


def test_op1_blocks_cover_the_radius(spark):
    """Fingerprints within the radius share a block, whatever bits differ."""
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(63)
        b = a
        for bit in rng.sample(range(63), op1_decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((a, b))
    d = spark.createDataFrame(rows, "a long, b long").selectExpr(f"{op1_decontaminate.blocks_sql('a')} as x", f"{op1_decontaminate.blocks_sql('b')} as y")
    assert d.where("not arrays_overlap(x, y)").count() == 0


# 2


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def base_spans(t):
    out = [("email", x) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", x) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x[0].split("."))]
    out += [("card", x) for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", x[0])) <= 19 and luhn(d)]
    out += [("phone", x) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", x[0])) <= 15]
    return ",".join(f"{k}:{x.start()}:{x.end()}" for k, x in out)


def test_op2_base_spans(spark, docs):
    rng = random.Random(1)
    parts = ["a", "b.", "@", "x@y.z", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (377) 555-0271", " ", "-", "9807 9157 6280 4490", "4111111111111111", "4111-1111-1111-1111", "_", "é", "\n", "+", "(", "..", "00", "7", "a@b.c@d.e", "𝒳", 'key = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"']
    texts = docs[:300] + [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    got = op2_pii.digest(op2_pii.find(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    of = dict(texts)
    for r in got:
        want = base_spans(of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len([x for x in want.split(",") if x])


def test_op2_adds_secrets_and_redacts(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    texts = [(i, f'Before it token = "{h}" and a word, write to me@mail.example.org or 2345 {i}.') for i, h in enumerate(hexes)] + [(99, "Nothing here at all, 12 of 1999."), (100, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    by = {r.doc_id: r.spans for r in op2_pii.digest(op2_pii.find(d)).collect()}
    assert all(f"secret:{t.index(h)}:{t.index(h) + 40}" in by[i] for (i, t), h in zip(texts, hexes)) and by[99] == ""
    out = {r.doc_id: r.text for r in op2_pii.redacted(d).collect()}
    assert out[3].startswith('Before it token = "[secret]" and a word, write to [email] or') and out[99] == texts[-2][1] and out[100] is None


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "a@b." * 20_000, "+1(" * 60_000, "1.2.3.4 " * 8_000, "A1" * 100_000, "+1" + "(" * 100_000])
def test_op2_is_linear(spark, text):
    assert op2_pii.digest(op2_pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).count() == 1


def test_op2_reliabilities_recover_labelers():
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(5000):
        y = rng.random() < 0.4
        votes = [0] * 6
        for l, right in ((0, 0.95), (1, 0.6), (3, 0.9)):
            votes[l] = 1 if (rng.random() < right) == y else 0
        counts["secret", tuple(votes)] += 1
    rate, vote, _ = op2_pii.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert abs(rate["secret"] - 0.4) < 0.05 and vote[0, 1, 1] > 0.9 and abs(vote[1, 1, 1] - 0.6) < 0.06


# 3


def test_op3_pages_and_generated(spark):
    import html as h

    model = op3_html.fit()
    for (source,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", source, re.S)[1]
        blocks = [re.sub(r"[\x20\t-\r]+", " ", h.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?p>|<br>|</?h1>", inner)]
        assert op3_html.main_text(source, model) == " ".join(x for x in blocks if x)
    rng, exact = np.random.default_rng(4321), 0
    for _ in range(100):
        source = op3_html.generated(rng)
        page = op3_html.Page(source, training=True)
        exact += page.text(np.array(page.truth) == 1) == op3_html.main_text(source, model)
    assert exact >= 95


def test_op3_decoding_has_no_contradictions():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        kept = op3_html.decoded(parent, rng.random(n) * 5, np.clip(rng.random(n), 0.01, 0.99))
        for i in range(1, n):
            above, p = [], parent[i]
            while p >= 0:
                above.append(kept[p])
                p = parent[p]
            # once kept and dropped again, nothing below comes back
            assert not (kept[i] and True in above and not above[0])


# 4


def test_op4_targets_and_takes(spark):
    m = op4_mix.op4_mix(spark, SF).toPandas()
    src = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").toPandas()
    size = src.text.map(lambda t: len(words(t)))
    by = size.groupby(src.source).sum()
    names = sorted(by.index)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * by.sum(), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * by[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
        open_ -= full
    j = m.merge(src[["doc_id", "source"]], on="doc_id")
    assert len(m) == len(src) and (j["size"].values == size[j.doc_id.map(dict(zip(src.doc_id, src.index)))].values).all()
    taken = j.groupby("source").taken.sum()
    for s in names:
        rows = j[j.source == s]
        assert np.allclose(rows.target, target[s]) and (rows.source_size == by[s]).all()
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 1)
    assert (j.taken <= 2 * j["size"]).all() and (j.taken % j["size"].clip(lower=1) == 0).all()
    again = op4_mix.op4_mix(spark, SF).toPandas()
    assert sorted(map(str, again.itertuples(index=False))) == sorted(map(str, m.itertuples(index=False)))


def test_op4_splits_are_exact(spark):
    q = spark.createDataFrame([(k, n) for k, n in enumerate([1, 0, 5, 700, 33], 1)], "rank int, q long")
    got = {r["rank"]: list(r["per_shard"]) for r in op4_mix.shard_quotas(q, 4, 9).collect()}
    assert {k: sum(v) for k, v in got.items()} == {1: 1, 2: 0, 3: 5, 4: 700, 5: 33}
    shards = [sum(v[s] for v in got.values()) for s in range(16)]
    assert max(shards) - min(shards) <= 4


# 5, 7, 8


@pytest.mark.parametrize("name, run, sql", [("op5", op5_rules.op5_quality_rules, op5_rules.OP5_SQL), ("op7", op7_license.op7_license_scan, op7_license.OP7_SQL), ("op8", op8_minhash.op8_minhash, op8_minhash.OP8_SQL)])
def test_same_as_sql(spark, name, run, sql):
    same(run(spark, SF), sql, SF)


def test_op7_gate_is_lossless():
    for name, text in op7_license.TEMPLATES.items():
        grams = op7_license.bigrams(text)
        gate = set(op7_license.gate_words(op7_license.TEMPLATES, op7_license.LEAST))
        shared = next(k for k in range(1, len(grams) + 1) if any(2 * k / (len(grams) + u) >= op7_license.LEAST for u in range(k, 3 * len(grams))))
        assert sum(not (set(g.split()) & gate) for g in grams) < shared, name


def test_op8_groups_of_near_copies(spark, monkeypatch):
    """Copies around centres, and chains, in blocks much smaller than the groups."""
    rng = random.Random(8)
    docs = []
    for g in range(4):
        centre = [f"g{g}w{i}" for i in range(150)]
        for _ in range(60):
            w = list(centre)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                w[rng.randrange(150)] = f"x{rng.random()}"
            docs.append(" ".join(w))
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        docs.append(" ".join(chain[4 * k : 4 * k + 100]))
    rng.shuffle(docs)
    monkeypatch.setattr(op8_minhash.in_blocks, "__defaults__", (16, 30_000))
    got = {r.doc_id: r.component_id for r in op8_minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (d.split() for d in docs)]
    best = list(range(len(docs)))

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                best[b] = a
    assert got == {i: find(i) for i in range(len(docs))}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b and near[a] == {a}}
    assert got == {k: v for k, v in want.items() if k not in loops}


# 9


def test_op9_is_the_model(spark, docs):
    tokens = lambda t: [w.translate(ASCII_LOWER) for w in words(t)] + ["\0end"]
    uni, bi = collections.Counter(), collections.Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["\0begin", *w], w))
    n, v, pairs = sum(uni.values()), len(uni), len(bi)
    preceding = collections.Counter(b for _, b in bi)

    def discount(values):
        c = collections.Counter(values)
        y = c[1] / (c[1] + 2 * c[2])
        return [0, 1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]]

    d1, d2 = discount(preceding.values()), discount(bi.values())
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in bi.items():
        context[a][0] += k
        context[a][min(k, 3)] += 1
    spare = sum(d1[min(k, 3)] for k in preceding.values()) / pairs

    def p(a, b):
        low = max(preceding[b] - d1[min(preceding[b], 3)], 0) / pairs + spare / (v + 1)
        if a not in context:
            return low
        x, k = context[a], bi[a, b]
        return max(k - d2[min(k, 3)], 0) / x[0] + sum(d2[i] * x[i] for i in (1, 2, 3)) / x[0] * low

    got = {r.doc_id: r for r in op9_lm.op9_lm(spark, SF).collect()}
    for d, t in docs:
        w, r = tokens(t), got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["\0begin", *w], w)), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / len(w)), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# 6, 10


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.1"
    x = op6_quality.op6_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = x[x.quality == 1].score.values, x[x.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert (x[x.quality == 1].predicted == 1).mean() > 0.99 and (x[x.quality == 0].predicted == 0).mean() > 0.95


def test_op10_held_out(spark):
    sf = "/root/testdata/sf0.1"
    x = op10_language.op10_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (x.lang == x.lang_pred).mean() > 0.98


# pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision on its own input."""
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in d.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, d, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        if name != "mixing":
            assert out.columns == d.columns and len(rows) == len(after) and set(after) <= set(before)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(i in after for i, q in labels.items() if q == 1) and sum(i not in after for i, q in labels.items() if q == 0) >= 0.95 * sum(q == 0 for q in labels.values())
        if name == "near_dedup":
            sets = {i: set(windows(w) if len(w := [x.translate(ASCII_LOWER) for x in words(t)]) >= 5 else [tuple(w)] if w else []) for i, t in before.items()}
            alike = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
            gone, stay = sorted(set(before) - set(after)), sorted(after)
            assert gone and not any(alike(sets[a], sets[b]) for k, a in enumerate(stay) for b in stay[:k])
            assert all(any(alike(sets[i], sets[j]) for j in before if j != i) for i in gone)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(before) - set(after) == {i for i, _ in leaks(list(before.items()), items)}
        if name == "pii":
            assert set(after) == set(before) and all(base_spans(t or "") == "" for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not re.search(r"[0-9@]", t)) and all(r.n_chars == len(r.text) for r in rows)
        if name == "mixing":
            assert {"copy", "shard", "order_key"} <= set(out.columns) and all(after[i] == before[i] for i in after)
            assert max(collections.Counter(r.doc_id for r in rows).values()) == 2
        d, before = out, after
