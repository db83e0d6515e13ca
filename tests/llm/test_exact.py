"""Operators against brute force where a group, a window or a model has to be searched whole."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from manuscribe.llm import decontam, license_scan, lm_score, minhash, packing, quality
from manuscribe.llm.textarrays import FOLDED, words
from manuscribe.llm.textarrays import chunks as text_chunks

_letters = random.Random(0)
WORDS = ["q" + "".join(_letters.choice("abcdefgh") for _ in range(5)) for _ in range(900)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def shingles(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(sets, num, den):
    comp = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp, len(links)


@pytest.mark.parametrize(("seed", "rates"), [(1, (0.02, 0.05)), (2, (0.01, 0.12)), (3, (0.04, 0.045))])
def test_a_large_group_about_the_threshold(spark, seed, rates):
    """Copies of one text with so many words changed that some link, some only through others, and some not."""
    rng = random.Random(seed)
    base, texts = prose(rng, 160), []
    for _ in range(150):
        rate, w = rng.uniform(*rates), base[:]
        for i in range(len(w)):
            if rng.random() < rate:
                w[i] = rng.choice(WORDS[:30] if rng.random() < 0.5 else WORDS)
        texts.append(" ".join(w[: rng.randrange(140, 161)]))
    texts += [" ".join(base[:100] + prose(rng, 60)) for _ in range(40)] + [" ".join(prose(rng, 150)) for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[j]) for i, j in enumerate(order)], "doc_id long, text string").repartition(4)
    comp, links = brute_components({i: shingles(texts[j].split(), 3) for i, j in enumerate(order)}, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=3, similarity=(85, 100)).collect()}
    assert links > 20
    assert got == comp


def test_members_listed_by_difference(spark, monkeypatch):
    """The same when families are compared by each listed difference, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    test_a_large_group_about_the_threshold(spark, 4, (0.03, 0.07))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids, repeated rows and ids, and columns whose names operators might take."""
    rng = random.Random(8)
    item, base = prose(rng, 30), prose(rng, 120)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (None, " ".join(base)), (3, " ".join(prose(rng, 40) + item)), (None, " ".join(item)), (3, " ".join(prose(rng, 50))), (4, None), (5, ""), (None, None), (None, " ".join(prose(rng, 20)))]
    return spark.createDataFrame([(i, t, "k", 1, 2, "x") for i, t in rows], "doc_id long, text string, _gone string, _bad long, own_id int, text_hash string"), " ".join(item)


def test_filters_decide_by_row_and_keep_all_columns(spark, odd_docs):
    docs, item = odd_docs
    got = minhash.keep_one(docs)
    assert got.schema == docs.schema
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sum(t is not None and len(t.split()) == 120 for _, t in left) == 1 and (1, docs.filter("doc_id = 1").first()["text"]) in left
    assert len([1 for i, t in left if t in (None, "")]) == 3
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontam.keep_clean(docs, bench)
    assert clean.schema == docs.schema
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert not [t for _, t in left if t and item in t] and len(left) == docs.count() - 2
    assert (3 in [i for i, _ in left]) and len([1 for i, _ in left if i is None]) == 3
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, threshold=0.5)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    assert quality.keep_good(docs, labels, threshold=0.6).count() == 0


def test_lm_score(spark):
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(40)] + [None, "", " \n", "One", "one ONE One"]
    texts += [texts[3], texts[3]]
    ids = [None if i == 7 else i for i in range(len(texts))]
    target = {i for i in range(0, 20)} | {42}
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = lm_score.score(docs, spark.createDataFrame([(i,) for i in [*target, None, 0, 999]], "doc_id long")).collect()
    assert len(got) == len(texts)
    said = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    uni, bi = {}, {}
    for name in "bt":
        use = [w for i, w in zip(ids, said, strict=True) if name == "b" or i in target]
        uni[name], bi[name] = Counter(x for w in use for x in w), Counter(p for w in use for p in itertools.pairwise(w))
    size = len(uni["b"])

    def loss(i, w, name):
        own = name == "b" or i in target
        u, b, total, out = Counter(w), Counter(itertools.pairwise(w)), max(sum(uni[name].values()) - own * len(w), 1), 0.0
        for prev, x in zip([None, *w], w, strict=False):
            one = (uni[name][x] - own * u[x]) / total
            before = uni[name][prev] - own * u[prev] if prev else 0
            two = (bi[name][prev, x] - own * b[prev, x]) / before if before > 0 else one
            out -= math.log(0.6 * two + 0.3 * one + 0.1 / size)
        return out / len(w)

    want = sorted((-1 if i is None else i, len(w), *([round(loss(i, w, "t"), 9), round(loss(i, w, "b"), 9)] if w else [None, None])) for i, w in zip(ids, said, strict=True))
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], *[None if r[c] is None else round(r[c], 9) for c in ("ce_target", "ce_background")]) for r in got)
    assert have == want


def test_lm_score_in_many_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_TOKENS", 100)
    test_lm_score(spark)


def test_neighbours_are_those_of_bm25(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 80)) for _ in range(60)]
    import pyarrow as pa

    terms = []
    for _, _, data, offs in text_chunks(pa.array([" ".join(t) for t in texts])):
        h, bounds = words(data, offs, FOLDED)
        terms += [h[a:b] for a, b in itertools.pairwise(bounds.tolist())]
    index = packing.Index(terms)
    n, df, mean = len(texts), Counter(x for t in texts for x in set(t)), sum(map(len, texts)) / len(texts)
    used = np.zeros(n, bool)
    used[::7] = True
    for q in range(0, n, 5):
        want = []
        for d, t in enumerate(texts):
            tf = Counter(t)
            s = sum(math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in set(texts[q]) & set(t))
            want.append(s)
        assert np.allclose(index.scores(q), want)
        got = index.neighbours(q, used).tolist()
        assert set(got) == {d for d in range(n) if want[d] > 0 and not used[d]}
        assert all(want[a] >= want[b] - 1e-9 for a, b in itertools.pairwise(got))


def test_like_texts_share_shards(spark):
    """Copies stand together in the order of shards, wherever they were."""
    rng = random.Random(3)
    base = [prose(rng, 50) for _ in range(200)]
    rows = [(i, " ".join(w[: 50 - c])) for c in range(2) for i, w in enumerate(base, c * 200)]
    rng.shuffle(rows)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shard_bytes=8_000, window=256).toPandas()
    shard = dict(zip(out.doc_id, out.sequence_id.to_numpy() >> 24, strict=True))
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()
    assert len(set(shard.values())) > 10
    assert sum(shard[i] == shard[i + 200] for i in range(200)) > 150


def letters(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_license_scan(spark):
    rng = random.Random(6)
    temp = [(i, n, t) for i, (n, t) in enumerate(license_scan.TEMPLATES)] + [(90, "two", "Twice Said"), (91, "none", " ")]
    texts = [None, "", "no license"]
    for _, _, t in temp * 2:
        w = letters(t)
        for k in range(len(w) // 12):
            w[rng.randrange(len(w))] = f"changed{k}" if rng.random() < 0.7 else w[0]
        texts += [" ".join(prose(rng, rng.randrange(0, 60)) + letters(t) + prose(rng, 9)), " ".join(prose(rng, rng.randrange(0, 30)) + w)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3])], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["template_id"]): (r["start_word"], round(r["containment"], 9)) for r in license_scan.scan(docs, spark.createDataFrame(temp, "template_id int, license string, text string")).collect()}
    want = {}
    for tid, _, t in temp:
        own = letters(t)
        n = min(5, len(own))
        grams = shingles(own, n) if own else set()
        for i, text in enumerate(texts):
            w, best = letters(text), None
            for s in range(0, len(w), max(len(own), 1)):
                window = w[s : s + 2 * len(own)]
                at = [k for k in range(len(window) - n + 1) if tuple(window[k : k + n]) in grams]
                share = len({tuple(window[k : k + n]) for k in at}) / len(grams) if grams else 0
                if share >= 0.8 - 1e-9 and (best is None or share > best[1] + 1e-12):
                    best = (s + at[0], share)
            if best:
                want[i, tid] = (best[0], round(best[1], 9))
    assert got == want
    assert license_scan.scan(docs.filter("false"), license_scan.templates(spark)).count() == 0


def test_decontamination_over_every_window(spark):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate((15, 22, 22, 31, 40, 57, 57, 3, 1, 120))]
    items += [(20, items[4][1] + " more"), (21, " ".join(letters(items[5][1])[:30] + prose(rng, 20))), (22, None), (23, "")]
    texts = [None, "", "short"]
    for _ in range(4):
        for _, t in items:
            w = letters(t)
            for _ in range(len(w) // 25):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["odd"], [w[i], "odd"]])
            texts.append(" ".join(prose(rng, rng.randrange(0, 40)) + w + prose(rng, rng.randrange(0, 30))))
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[3])], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 6)) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    own = {i: letters(t) for i, t in items if letters(t)}
    want = {}
    for n in {min(5, len(w)) for w in own.values()}:
        mine = {i: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for i, w in own.items() if min(5, len(w)) == n}
        weight = {g: 1 / c for g, c in Counter(g for grams in mine.values() for g in grams).items()}
        for i, grams in mine.items():
            for d, text in enumerate(texts):
                w, best = letters(text), None
                for s in range(max(1, len(w) - n + 1)):
                    window = w[s : s + len(own[i])]
                    c = Counter(tuple(window[k : k + n]) for k in range(len(window) - n + 1))
                    both = sum(min(c[g], grams[g]) * weight.get(g, 1) for g in c)
                    all_ = sum(max(c[g], grams[g]) * weight.get(g, 1) for g in {*c, *grams})
                    if both >= (0.8 - 1e-9) * all_ and (best is None or both / all_ > best[1] + 1e-9):
                        best = (s, both / all_)
                if best:
                    want[d, i] = (best[0], round(best[1], 6))
    assert len(want) > 20
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert got == want


@pytest.mark.parametrize("block", [512, 2])
def test_unrelated_members_of_a_family_are_parted(spark, monkeypatch, block):
    """Pairs that only two common values bring into one family are kin by themselves; one that shares too few has none."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(1, 10 * p + i, 8, [p * 100 + j for j in range(9)] + [1, 2]) for p in range(1, 6) for i in (0, 1)] + [(1, 99, 8, [100, 101, 200, 201, 300, 301, 1, 2])]
    able = spark.createDataFrame(rows, "fam long, id long, need int, v array<long>")
    got = minhash._kin(minhash.Scratch(spark, "kin"), able).collect()
    assert {(r["fam"], r["id"]) for r in got} == {(10 * p, 10 * p + i) for p in range(1, 6) for i in (0, 1)}


def test_a_large_group_with_enough_links(spark, monkeypatch):
    """Near copies of one text, most of them kin, against all pairs, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    base, texts = prose(rng, 160), []
    for _ in range(150):
        rate = rng.uniform(0.01, 0.06)
        texts.append(" ".join(rng.choice(WORDS) if rng.random() < rate else w for w in base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    comp, links = brute_components({i: shingles(t.split(), 3) for i, t in enumerate(texts)}, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=3, similarity=(85, 100)).collect()}
    assert links > 20 and got == comp


def test_the_quality_model_is_trained_by_a_worker(spark, monkeypatch):
    """Neither the sample nor the training is in the driver; the model is that of the rows in order of their ids."""
    rng = random.Random(9)
    rows = [(i, " ".join(prose(rng, 20) + (["good"] * 3 if i % 2 else ["bad"] * 3)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sample = pa.RecordBatch.from_arrays([pa.array([r[0] for r in taught]), pa.array([r[2] for r in taught], pa.int32()), pa.array([r[1] for r in taught])], ["at", "label", "text"])
    (h,) = quality._histograms(iter([sample]))
    y = np.array([r[2] for r in taught])
    weights, bias = quality.train(y, [x.values.to_numpy() for x in h["buckets"]], [x.values.to_numpy() for x in h["counts"]], float(y.mean()))

    here, train = os.getpid(), quality.train

    def elsewhere(*given):
        assert os.getpid() != here, "trained in the driver"
        return train(*given)

    monkeypatch.setattr(quality, "train", elsewhere)
    got = quality.fit(docs, labels, "doc_id", "text", "quality", 1500)
    assert (got[0] == weights).all() and got[1] == bias
