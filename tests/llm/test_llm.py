"""The training-data operators against brute force on small tables that hold nulls, empty and long texts, ties,
repeated rows and columns with clashing names."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import counts, decontaminate, gru, lines, lm, mil, mixing, quality_rules, sharding, simhash, toxicity, urls
from plumbline.llm.text import Words

SCHEMA = "doc_id long, text string, source string, kept boolean, size string, shard int, score string"
RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(200)] + ["the", "of", "and"] * 30


def prose(n: int) -> str:
    return "\n".join(" ".join(RNG.choice(WORDS) for _ in range(min(12, n - k))) + "." for k in range(0, n, 12))


def make_docs() -> list[tuple]:
    rows = []
    base = prose(120)
    for i in range(40):
        rows.append((i, prose(30 + 5 * i), f"s{i % 4}"))
    rows += [(100 + i, base, "s0") for i in range(8)]  # copies
    rows += [(120 + i, base.replace("w1", f"q{i}", 1), "hot") for i in range(8)]  # near copies
    rows += [(140, None, None), (141, "", "s1"), (142, " \n\t ", "s1"), (143, "one", "s2"), (143, "one", "s2"), (None, prose(40), "s3"), (144, prose(9000), "s3"), (145, "ÉTÉ été Ünï\x0bx", "s2")]
    return [(i, t, s, True, "x", 3, "y") for i, t, s in rows]


@pytest.fixture(scope="module")
def rows():
    RNG.seed(5)
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().lower().split()


def test_words_match_bytes_split():
    texts = ["A b\tc", "", None, " x\x0b\x0cy ", "é É ß", "end"]
    w = Words(pa.array(texts))
    got = [[bytes(w.data[a:b]) for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [split(t) for t in texts]
    again = Words(pa.array(["c x é", "A"]))
    assert w.hashes()[2] == again.hashes()[0] and len(set(w.hashes())) == len({x for t in texts for x in split(t)})


def fingerprint(text):
    w = split(text)
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [1000, 1])
def test_simhash_against_all_pairs(spark, docs, rows, hot):
    got = simhash.near_duplicates(docs, hot_bucket=hot).collect()
    want = [(r[0], fingerprint(r[1])) for r in rows]
    label = {f: f for _, f in want}
    for a in label:
        for b in label:
            if bin(a ^ b).count("1") <= 2:
                low = min(label[a], label[b])
                label = {k: low if v in (label[a], label[b]) else v for k, v in label.items()}
    lowest = {}
    for i, f in want:
        if i is not None:
            lowest[label[f]] = min(i, lowest.get(label[f], 1 << 60))
    expect = collections.Counter((i, f, lowest.get(label[f])) for i, f in want)
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == expect
    if hot == 1000:
        assert simhash.near_duplicates(empty(spark)).count() == 0


def test_toxicity_chain(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(240):
        words = [f"w{k}" for k in rng.integers(0, 60, 40)]
        toxic = i % 4 == 0
        if toxic:
            words[int(rng.integers(40))] = ("zorb", "quax", "lowei" + str(i))[i // 4 % 3]
        rows.append((i, " ".join(words), i, "keep"))
        labels.append((i, int(toxic)))
    rows += [(None, None, 0, "keep"), (900, "", 0, "keep"), (901, "You ZORB, you quax!", 0, "keep")]
    d = spark.createDataFrame(rows, "doc_id long, text string, p_toxic long, note string")
    y = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    assert len(got) == len(rows) and got[0].note == "keep" and got[901].is_toxic and not got[900].is_toxic
    right = sum(got[i].is_toxic == bool(t) for i, t in labels)
    assert right >= 234
    assert toxicity.toxicity(d, y.limit(0)).where("is_toxic").count() == 0
    assert toxicity.toxicity(d.limit(0), y).count() == 0
    again = toxicity.toxicity(d.union(d.where("doc_id < 20")).repartition(5), y.union(y))
    assert {(r.doc_id, r.p_toxic) for r in again.collect()} == {(r.doc_id, r.p_toxic) for r in got.values()}


def test_language_model_counts_and_gain(spark, docs, rows):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lm.score(docs, held).collect()
    out = {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(x for i, t, *_ in rows if i not in out for x in [*split(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t, *_ in rows:
        w = [*split(t), None]
        want[i, i in out, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(empty(spark), held).count() == 0


def test_gru_is_a_distribution():
    classes = gru.classes_of(6)
    p = gru.start(np.array([9, 7, 5, 3, 2, 1]), classes, 3, 4, 0)
    total = sum(math.exp(gru.log_probabilities(p, classes, [np.array([a, b], np.int32)])[0]) for a in range(6) for b in range(6))
    assert abs(total - 1) < 1e-4


def test_quality_rules(spark, docs, rows):
    got = quality_rules.quality(docs)
    assert {"source", "kept", "score"} <= set(got.columns)
    want = collections.Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        again = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        ls = [x for x in t.split("\n") if x.encode().split()]
        want[i, len(w), sum(len(x.decode()) for x in w), sum(t.count(x) for x in "#*$%&|<>"), len(ls) - len(set(ls)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    assert collections.Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS], r.base_failed) for r in got.collect()) == want
    assert quality_rules.quality(empty(spark)).count() == 0
    junk = ["Abc### def%%% ghi*** " * 3 + " ".join(f"x{i}$$$" for i in range(k, k + 40)) for k in range(30)]
    good = [prose(80).replace("w", "word") for _ in range(200)]
    votes = quality_rules.measure(pa.array(junk + good))[1]
    u, n = np.unique(votes, axis=0, return_counts=True)
    p = quality_rules.posterior(votes, *quality_rules.estimate(u, n.astype(float)))
    assert (p[:30] < 0.5).all() and (p[30:] > 0.5).mean() > 0.98


@pytest.mark.parametrize("few", [10_000, 1])
def test_mixing(spark, docs, rows, few):
    got = mixing.mix(docs, few=few).collect()
    size = lambda t: len((t or "").encode().split())
    sums = collections.Counter()
    for _, t, s, *_ in rows:
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sums.values()), set()
    while True:
        rest = total - sum(3 * sums[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and 3 * sums[s] < level * weight[s]}
        if not new:
            break
        capped |= new
    target = {s: 3 * sums[s] if s in capped else level * weight[s] for s in order}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sums[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.size == size(r.text) and math.floor(r.rate) <= r.copies <= min(3, math.floor(r.rate) + 1)
    emitted = mixing.emit(mixing.mix(docs.drop("size"), few=few))
    assert emitted.count() == sum(r.copies for r in got) and emitted.columns == [c for c in docs.columns if c != "size"]
    assert mixing.mix(empty(spark)).count() == 0


def test_url_rules_against_all_rules(spark):
    cases = ["http://a.example.com/en/x?q", "https://WWW.Example.com/en/", "http://example.com", "http://x.net/es/1", "http://net/fr/", "http://my.org/casino/bonus", "http://ADS3.org", "http://x.org/user/login.php", "http://x.org/Wp-Admin/a", "notaurl", "", None, "x://h.com:80/a", "http://b.com/#c", "http://casinos.org/", "http://x.org/a/KEYGEN-crack?"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    import re

    for i, u in enumerate(cases):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group().lower()
        path = re.match("[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(n), n, v) for n, v in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")) if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith(n[n.index("/") :])]
        rule = max(fits)[1] if fits else None
        block = any(re.search(p, host + path) for _, p, _ in urls.PATTERNS)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (max(fits)[2] if fits else "block" if block else "allow"), u
    with pytest.raises(ValueError):
        urls.judge(df, (urls.domain_rule("allow", "com"),) * 2)
    assert urls.judge(df.limit(0)).count() == 0


def test_hundreds_of_rules_against_all_rules(spark):
    """Rules of several tokens, so the index has a choice; each URL's verdict as if all rules had run."""
    import re

    rng = random.Random(12)
    words = [f"t{i}" for i in range(60)] + ["com", "www", "net"]
    rules = [urls.domain_rule(v, h, p) for k in range(200) for v, h, p in [(rng.choice(["allow", "block"]), ".".join(rng.choices(words, k=rng.choice([1, 2, 3]))), "/" + "/".join(rng.choices(words, k=rng.choice([0, 1, 2]))))]]
    rules = list({r.name: r for r in rules}.values())
    rules += [urls.Rule(f"m{k}", "block", f"/{a}/.*/{b}(?:/|$)", (a, b), k, "method") for k in range(60) for a, b in [rng.choices(words, k=2)]]
    rules += [urls.Rule("any q", "block", "q+", (), 7, "method")]
    cases = ["http://" + ".".join(rng.choices(words, k=rng.choice([1, 2, 3]))) + "/" + "/".join(rng.choices([*words, "qq", "x"], k=rng.choice([0, 1, 3, 5]))) for _ in range(1500)]
    cases += cases[:20] + [None, ""]
    df = spark.createDataFrame([(i, u, "e") for i, u in enumerate(cases)], "page_id long, url string, verdict string").repartition(3)
    got = {r.page_id: (r.rule, r.verdict, r.by) for r in urls.judge(df, tuple(rules)).collect()}
    found = 0
    for i, u in enumerate(cases):
        host, _, path = (u or "://").split("://")[1].partition("/")
        target = host + ("/" + path if u else "")
        best = max(((r.weight, r.name, r.verdict, r.kind) for r in rules if re.search(r.pattern, target)), default=None)
        want = (None, "allow", "default") if best is None else (best[1] if best[3] == "rule" else None, best[2], best[3])
        found += best is not None
        assert got[i] == want, u
    assert found > 300


def edits(a, b):
    """Least edit distance of a and any stretch of b."""
    d = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j - 1] + (x != y), d[j] + 1, new[-1] + 1))
        d = new
    return min(d)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 20, 37, 55, 120])))) for k in range(25)] + [(90, None), (91, ""), (None, "x y")]
    rows = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 60, 150]))]
        item = items[i % 25][1].split()
        if i % 2:
            for _ in range(rng.randint(0, int(0.2 * len(item)))):
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice([[], ["zz"], [item[k], "yy"]])
                item = item or ["zz"]
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() + "," for x in item] + w[at:]
        rows.append((i, " ".join(w), "extra"))
    rows += [(500, None, "extra"), (None, items[3][1], "extra"), (501, items[3][1], "extra"), (501, items[3][1], "extra")]
    d = spark.createDataFrame(rows, "doc_id long, text string, distance string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(d, it).collect())
    want = collections.Counter()
    for i, t, _ in rows:
        words = [x.strip(",").lower() for x in (t or "").split()]
        for k, x in items:
            a = (x or "").split()
            if k is not None and a:
                e = edits(a, words)
                if e <= len(a) - math.ceil(0.8 * len(a) - 1e-9):
                    want[i, k, e] += 1
    assert not got - want
    assert sum((got & want).values()) >= 0.95 * sum(want.values())
    kept = decontaminate.clean(d, it)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, *_ in rows} - {i for i, *_ in want}
    assert decontaminate.matches(d.limit(0), it).count() == 0 and decontaminate.clean(d, it.limit(0)).count() == len(rows)


def test_attention_model(spark):
    r = np.random.default_rng(0)
    model = mil.Model(3)
    first = np.array([0, 2, 3, 7])
    x, y = r.normal(size=(7, mil.WIDTH)), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(out := model.forward(x, first)[-1]) + (1 - y) * np.log(1 - out)).mean())
    g = model.gradient(x, first, y)
    for q in model.p:
        flat, at = model.p[q].reshape(-1), 1 % model.p[q].size
        old = flat[at]
        flat[at] = old + 1e-6
        up = loss()
        flat[at] = old - 1e-6
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-6 - g[q].reshape(-1)[at]) < 1e-6, q
    rows = [(i, prose(150) if i % 3 else "### %%% " * 20 + "$$$ " * 60) for i in range(90)]
    d = spark.createDataFrame(rows + [(None, None), (200, "")], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    got = {s.doc_id: s.score for s in mil.score(d, mil.fit(d, y)).collect()}
    assert all((got[i] > 0.5) == (i % 3 > 0) for i in range(90)) and 0 <= got[None] <= 1 and 0 <= got[200] <= 1
    assert abs(mil.score(d, mil.fit(d, y.limit(0))).first().score - 0.5) < 1e-9


@pytest.mark.parametrize("options", [{}, {"cell": 1, "busy": 0}])
def test_lines_against_all_pairs(spark, docs, rows, options):
    got = lines.summary(docs, hot_words=20, **options).collect()
    order = sorted({(1 << 62 if i is None else i, t or "") for i, t, *_ in rows}, key=lambda r: r[0])
    every = [(i, t, p, frozenset(x.encode().lower().split())) for i, t in order for p, x in enumerate(t.split("\n")) if x.split()]
    first = {}
    for i, t, p, s in every:
        first.setdefault(s, (i, p))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    links = {(a, b) for a in first for b in first if a != b and len(a) > 3 and jaccard(a, b) >= 0.8}
    late = {a for a, b in links if first[b] < first[a]}
    partners = collections.Counter(a for a, _ in links)
    want = collections.Counter()
    for i, t in order:
        own = [(p, s) for j, u, p, s in every if (j, u) == (i, t)]
        removed = [p for p, s in own if first[s] != (i, p) or s in late]
        want[None if i == 1 << 62 else i, len(own), sum(partners[s] for _, s in own), tuple(removed)] += 1
    assert len(links) > 0
    assert collections.Counter((r.doc_id, r.n_lines, r.n_links, tuple(r.removed_lines)) for r in got) == want
    classes = {}
    for r in got:
        for c in r.line_classes:
            classes[c] = classes.get(c, 0) + 1
    assert sorted(classes.values()) == sorted(collections.Counter(s for *_, s in every).values())
    if not options:
        cleaned = lines.remove(docs, hot_words=20)
        assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
        assert sum(len(r.text.split("\n")) for r in cleaned.where("doc_id >= 101 and doc_id < 108").collect() if r.text) == 0
        assert lines.summary(empty(spark)).count() == 0


def test_sharding(spark, docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    load = {r.shard: r for r in sharding.shard(hot, 8).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    assert len(load) == 8 and max(r.b for r in load.values()) < 1.1 * min(r.b for r in load.values()) and max(r.n for r in load.values()) < 1.2 * min(r.n for r in load.values())
    assert sharding.shard(empty(spark)).count() == 0


def test_lookup():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (counts.Lookup(h, 10).find(h) == np.arange(5000)).all()
    assert (counts.Lookup(h, 10).find(h + np.uint64(1)) == -1).mean() > 0.99
    assert (counts.Lookup(h[:0], 10).find(h) == -1).all()
