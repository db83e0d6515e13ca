"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manuscribe.llm import chat_format, decontam, embedding_dedup, license_scan, lm_score, minhash, packing, quality, token_count, warc

rng = random.Random(3)
WORDS = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
BASE = prose(120)
TEXTS = [None, "", " \n ", "One", "one", "two words", BASE, BASE.upper(), BASE + " tail", BASE.replace(" ", "\n"), prose(80), LONG, LONG + " end", "été été\x85x 你好", *[" ".join(w if i % 60 else "x" for i, w in enumerate(BASE.split(), k)) for k in range(8)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1, "k") for i, t in enumerate(TEXTS)] + [(6, BASE, "n", 1, "k"), (None, BASE, "n", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, v int, key string").repartition(3)


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_minhash(docs):
    s = {i: sets(t, 3) for i, t in enumerate(TEXTS)}
    comp = {i: i for i in s}
    for _ in s:
        for a, b in itertools.combinations(s, 2):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(docs, words=3, similarity=(85, 100)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"]), r


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert minhash.near_duplicates(none).count() == 0
    assert packing.pack(none).count() == 0
    assert token_count.token_counts(none).count() == 0
    assert quality.score(none, labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels).collect()} == {0.5}
    assert lm_score.score(none, labels).count() == 0
    assert decontam.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.default_model())
    for r in token_count.token_counts(docs, limit=5).collect():
        t = BASE if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 5)


def test_packing_is_an_exact_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(docs, window=256).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        assert set(own.doc_tokens) == {len(ids)}
        assert own.length.sum() == len(ids) * (2 if i == 6 else 1)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
        n = int(g.length.sum())
        assert n == 256 or n & (n - 1) == 0


def test_embeddings(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 16))
    x[50:120] = x[50] + 0.2 * r.standard_normal((70, 16))
    x[200:204] = x[200]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(900, None, "c"), (901, [0.0] * 16, "c"), (902, [float("nan")] * 16, "c"), (903, [1.0, None], "c"), (904, [], "c"), (None, x[0].tolist(), "c")]
    got = {q["vec_id"]: q for q in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    comp = np.arange(300)
    for _ in range(300):
        comp = np.array([comp[hit[i]].min() for i in range(300)])
    for i in range(300):
        assert (got[i]["n_links"], got[i]["component_id"]) == (hit[i].sum() - 1, comp[i])
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, None))


def _unit_rows(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _brute(u, threshold=0.9):
    hit = u @ u.T >= threshold
    comp = np.arange(len(u))
    while True:
        new = np.array([comp[h].min() for h in hit])
        if (new == comp).all():
            return hit.sum(axis=1) - 1, comp
        comp = new


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_groups_joined_by_one_link(spark, monkeypatch, block):
    """Two groups of 60 whose only link is between vectors that link with smaller ids, and closer ones, of their own groups."""
    r = np.random.default_rng(5)
    a = _unit_rows(r.standard_normal(64))
    c = r.standard_normal(64)
    b = 0.8 * a + 0.6 * _unit_rows(c - (c @ a) * a)
    x = np.concatenate([_unit_rows(m + 0.1 * _unit_rows(r.standard_normal((60, 64)))) for m in (a, b)])
    x[30], x[90] = _unit_rows(a + 0.25 * (b - a)), _unit_rows(b + 0.25 * (a - b))
    order = r.permutation(120)
    while min(np.flatnonzero(order < 60)) == np.flatnonzero(order == 30)[0] or min(np.flatnonzero(order >= 60)) == np.flatnonzero(order == 90)[0]:
        order = r.permutation(120)
    u = x[order]
    links, comp = _brute(u)
    side = order < 60
    assert ((u[side] @ u[~side].T) >= 0.9).sum() == 1 and set(comp) == {0}
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = {q["vec_id"]: q for q in embedding_dedup.near_duplicates(d, audit_rows=1).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (links[i], 0) for i in range(120))


def test_embedding_pairs_are_compared_when_the_audit_fails(spark, monkeypatch):
    """Isolated pairs that too few projections bring together."""
    r = np.random.default_rng(6)
    x = _unit_rows(r.standard_normal((200, 64)))
    y = _unit_rows(r.standard_normal((200, 64)))
    y = _unit_rows(y - (y * x).sum(axis=1, keepdims=True) * x)
    u = np.concatenate([x, 0.91 * x + np.sqrt(1 - 0.91**2) * y])
    links, comp = _brute(u)
    assert set(links) == {1}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "ALL_ROWS", 150, raising=False)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = {q["vec_id"]: q for q in embedding_dedup.near_duplicates(d, k=2, tables=1, most_rounds=1, audit_rows=100).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (1, comp[i]) for i in range(400))


@pytest.mark.parametrize("size", [2, 5, 30])
def test_embedding_groups_of_one_size_at_once(size):
    """Many groups compared together give what each gives alone."""
    r = np.random.default_rng(size)
    ids = np.array([np.sort(r.permutation(500)[:size]) for _ in range(40)])
    x = r.standard_normal((40, size, 8))
    x[::3, 1] = x[::3, 0] + 0.01
    x = _unit_rows(x)
    floor, outer, comp = r.uniform(-0.5, 0.5, (40, size)), r.uniform(-0.5, 0.5, (40, size)), np.where(np.arange(40)[:, None] % 2, ids, ids // 50)
    sims = x @ x.transpose(0, 2, 1)
    one = [part for i in range(40) for part in embedding_dedup._best(ids[i], sims[i].copy(), 4, 0.9, floor[i], outer[i], comp[i])]
    rows = [sorted((*q, repr(s)) for p in parts for *q, s in zip(*(a.tolist() for a in p), strict=True)) for parts in (one, embedding_dedup._best_of_each(ids, sims, 4, 0.9, floor, outer, comp))]
    assert rows[0] and rows[0] == rows[1]


@pytest.mark.parametrize("few", [True, False])
def test_embedding_vectors_of_two_lengths(spark, monkeypatch, few):
    """Vectors that fit a broadcast are not shuffled after the join; whether they do changes no result."""
    r, plans, keep = np.random.default_rng(8), [], embedding_dedup.Scratch.keep
    sets = [r.standard_normal((n, d)) for n, d in ((150, 16), (90, 8))]
    for x in sets:
        x[20:60] = x[20] + 0.2 * r.standard_normal((40, x.shape[1]))

    def noted(self, df, tag):
        if tag.startswith("found"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, tag)

    monkeypatch.setattr(embedding_dedup.Scratch, "keep", noted)
    if not few:
        monkeypatch.setattr(embedding_dedup, "checked_broadcast", lambda df, **_: df)
    d = spark.createDataFrame([(2 * i + j, v.tolist()) for j, x in enumerate(sets) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q["vec_id"]: q for q in embedding_dedup.near_duplicates(d, k=4).collect()}
    for j, x in enumerate(sets):
        links, comp = _brute(_unit_rows(x))
        assert links.any() and all((got[2 * i + j]["n_links"], got[2 * i + j]["component_id"]) == (links[i], 2 * comp[i] + j) for i in range(len(x)))
    if few:
        assert plans and all("Exchange" not in p[p.index("FlatMapGroupsInArrow") : p.index("BroadcastHashJoin [member")] for p in plans)


def test_chat(spark):
    a = [("user", "hi"), ("bot", "yo"), ("user", "x"), ("bot", None)]
    convs = {1: a[:2], 2: a, 3: a, 4: a[:1] + [("bot", "other")], 5: [("user", "x")], 6: a[:3]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(2, 0, "user", "hi"), (None, 0, "user", "hi")]
    got = {r["conv_id"]: r for r in chat_format.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=2).orderBy("part").collect()}
    assert set(got) == {2, 4, 5}
    assert got[2]["copies"] == 2 and got[2]["part"] == 1 and got[2]["chat"].endswith("<|im_start|>bot\n<|im_end|>\n")


def test_warc_round_trip(spark):
    big = "é" * 80 + "\r\n\r\nWARC/1.1\r\n"
    bodies = {1: big, 2: "x" * 100, 3: big, 4: "short", 5: "short", 6: None, 7: "", 8: "x" * 100}
    rows = [(i, None if i == 2 else f"http://a b/{i}\n", h) for i, h in bodies.items()] + [(None, "u", big), (3, "http://a b/3\n", big)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        h = (big if r["page_id"] is None else bodies[r["page_id"]] or "").encode()
        to = {3: 1, None: 1, 8: 2}.get(r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"]) == (len(h), hashlib.sha256(h).hexdigest(), to, "revisit" if to else "response")


def test_quality_learns(spark):
    good, bad = [prose(40) for _ in range(120)], [" ".join(f"{w}%%%" for w in prose(40).split()) for _ in range(120)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(None, "x"), (999, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = quality.score(d, lab).toPandas()
    own = got[got.doc_id < 240]
    held = own[own.held_out]
    assert ((held.doc_id < 120).astype(int) == (held.score > 0.5)).mean() > 0.95
    assert [bool(h) for h in own.held_out] == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in own.doc_id]
    assert got.score.between(0, 1).all() and len(got) == 242


def test_lm_prefers_its_target(spark):
    a, b = WORDS[:60], WORDS[200:260]
    texts = [" ".join(rng.choice(a if i < 40 else b) for _ in range(60)) for i in range(80)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], "doc_id long, text string")
    got = lm_score.score(d, spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "doc_id long")).toPandas().set_index("doc_id")
    assert got.score[:40].max() < got.score[40:80].min()
    assert got.loc[99].n_tokens == 0 and np.isnan(got.loc[99].score)


def test_lm_counts_every_ngram_apart(spark):
    """Against counts by words without the scored text's own, over more different words and bigrams than any fixed table has slots."""
    many = " ".join(f"v{i}" for i in range(700_000))
    texts = {1: "a b a b c", 2: "A b d", 3: many, 4: "b", 5: "", 6: None, 7: "a b"}
    rows = [*texts.items(), (7, "a b"), (None, "c a")]
    target = {1, 7}
    one, two = [{}, {}], [{}, {}]
    for i, text in rows:
        w = (text or "").lower().split()
        for k in (0, 1) if i in target else (1,):
            for a, b in zip([None, *w], w, strict=False):
                one[k][b] = one[k].get(b, 0) + 1
                if a is not None:
                    two[k][a, b] = two[k].get((a, b), 0) + 1

    def loss(k, i, text):
        own = k == 1 or i in target
        w, out = text.lower().split(), 0.0
        total = max(sum(one[k].values()) - own * len(w), 1)
        mine = {x: own * n for x, n in Counter(w).items()}, {x: own * n for x, n in Counter(itertools.pairwise(w)).items()}
        for a, b in zip([None, *w], w, strict=False):
            uni = (one[k].get(b, 0) - mine[0][b]) / total
            before = one[k].get(a, 0) - mine[0][a] if a is not None else 0
            bi = (two[k].get((a, b), 0) - mine[1][a, b]) / before if before else uni
            out -= np.log(0.6 * bi + 0.3 * uni + 0.1 / len(one[1]))
        return out / len(w)

    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.score(d, spark.createDataFrame([(1,), (7,), (None,)], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "c a" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(text.split())
        if text:
            assert (r["ce_target"], r["ce_background"]) == pytest.approx((loss(0, r["doc_id"], text), loss(1, r["doc_id"], text)), abs=1e-9), r
        else:
            assert r["score"] is None


def test_decontamination(spark, docs):
    item = prose(30)
    held = [(1, f"{prose(50)} {item} {prose(9)}"), (2, item.upper().replace(" ", ", ")), (3, prose(60)), (4, " ".join(item.split()[:20])), (5, "tiny one here"), (6, None), (None, item), (1, f"{item}")]
    d = spark.createDataFrame(held, "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, "Tiny one"), (12, ""), (13, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(d, b).collect()}
    assert got == {(1, 10): 1.0, (2, 10): 1.0, (5, 11): 1.0}
    # rows go by their own text: the one with a null id, which is the item, too
    assert sorted(r["doc_id"] or 0 for r in decontam.keep_clean(d, b).collect()) == [3, 4, 6]


def test_licenses(spark):
    t = license_scan.templates(spark)
    rows = [(1, f"{prose(31)} {license_scan.TEMPLATES[2][1]} {prose(8)}"), (2, prose(40)), (3, None), (4, license_scan.TEMPLATES[10][1].upper()), (None, license_scan.TEMPLATES[2][1])]
    got = {(r["doc_id"], r["license"], r["start_word"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), t).collect()}
    assert got == {(1, "MIT", 31), (4, "MPL-2.0", 0)}


def test_short_licenses_are_never_missed(spark):
    """Verbatim notices of 4 to 9 words among many different words, none at a window's start."""
    own = random.Random(8)
    notes = [(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES) if len(re.findall(r"\w+", t)) <= 9]
    rows = [(k * 8000 + d, f"a{own.random()} {t} " + " ".join(f"b{own.randrange(1 << 40)}" for _ in range(14))) for k, (_, t) in enumerate(notes) for d in range(8000)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.templates(spark)).select("doc_id", "template_id").collect()
    found = {(r["doc_id"], r["template_id"]) for r in got}
    assert not [d for d, _ in rows if (d, notes[d // 8000][0]) not in found]
