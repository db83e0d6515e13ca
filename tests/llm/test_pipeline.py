"""The pipeline against a brute-force version of its stages on a small fixture."""

import random
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from manuscribe.llm import packing, quality  # noqa: E402

rng = random.Random(11)
WORDS = ["v" + "".join(rng.choice("klmnopqrst") for _ in range(4)) for _ in range(500)]
JUNK = ["%%" + "".join(rng.choice("0123456789") for _ in range(3)) for _ in range(80)]


def prose(n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


ITEM = prose(30)
BASE = prose(150)
LONG = prose(9_000)


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def leaks_item(text):
    """Whether some window of the item's length shares 80 % of the weighted shingles with it (all its shingles weigh 1 here)."""
    item = re.findall(r"[^\W_]+", ITEM.lower())
    own, words = shingles(item), re.findall(r"[^\W_]+", (text or "").lower())
    windows = (shingles(words[s : s + len(item)]) for s in range(max(1, len(words) - len(item) + 1)))
    return any(len(w & own) / len(w | own) >= 0.8 for w in windows if w)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    texts = [prose(60) for _ in range(120)] + [prose(60, JUNK) for _ in range(60)]
    labels = [(i, int(i < 120), 0) for i in range(150)] + [(3, None, None), (None, 1, 0)]
    texts += [BASE, BASE.upper(), BASE + " tail", BASE.replace(" ", "\n"), LONG, LONG + " end", f"{prose(40)} {ITEM} {prose(40)}", ITEM, ITEM + " " + ITEM, None, "", "three short words", "three short words"]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)] + [(180, BASE, "xx", "s", 1), (None, prose(60), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_and_run_equal_brute_force(spark, sf_dir):
    all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in all_docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        got = stage[name](spark, docs, sf_dir)
        assert got.schema == docs.schema
        return got

    def same(df, expected):
        assert sorted(map(repr, df.collect())) == sorted(map(repr, spark.createDataFrame(expected, all_docs.schema).collect()))

    # a score depends on the text only: looked up by text, it decides rows with null ids too
    score = {}
    text_of = {}
    for i, t, *_ in rows:
        text_of.setdefault(i, set()).add(t)
    for r in quality.score(all_docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect():
        if len(text_of[r["doc_id"]]) == 1:
            score[next(iter(text_of[r["doc_id"]]))] = r["score"]
    good = [r for r in rows if score[r[1]] >= 0.7]
    assert {r[0] for r in good} >= set(range(120)) and not {r[0] for r in good} & set(range(120, 180))
    kept = after("quality", all_docs)
    same(kept, good)

    # null ids rank after all others, one number for each text
    rank = {t: 10**6 + k for k, t in enumerate(sorted({r[1] or "" for r in good}))}
    node = [rank[r[1] or ""] if r[0] is None else r[0] for r in good]
    sets = [(i, shingles(re.findall(r"[^\x20\x09-\x0D]+", folded(r[1])))) for i, r in zip(node, good, strict=True)]
    comp = {i: i for i in node}
    for _ in range(8):
        for i, a in sets:
            for j, b in sets:
                if a and b and 5 * len(a & b) >= 4 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    unique = [r for i, r in zip(node, good, strict=True) if comp[i] == i]
    assert len(unique) < len(good)
    kept = after("near_dedup", kept)
    same(kept, unique)

    clean = [r for r in unique if not leaks_item(r[1])]
    assert len(clean) < len(unique)
    kept = after("decontamination", kept)
    same(kept, clean)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for out in (stage["packing"](spark, kept, sf_dir).toPandas(), corpus_pipeline.run(spark, sf_dir).toPandas()):
        ids = {i: [tok.encode(t or "", add_special_tokens=False).ids + [1] for n, t, *_ in clean if n == i] for i in {r[0] for r in clean}}
        assert set(out.doc_id.dropna().astype(int)) == {i for i in ids if i is not None}
        assert out.length.sum() == sum(len(x) for many in ids.values() for x in many)
        for doc_id, own in out[out.doc_id.notna()].groupby("doc_id"):
            whole = ids[int(doc_id)]
            assert own.length.sum() == sum(map(len, whole))
            if len(whole) == 1:
                for r in own.itertuples():
                    piece = b"".join(x.to_bytes(4, "little") for x in whole[0][r.start : r.start + r.length])
                    assert (len(piece) // 4, zlib.crc32(piece), len(whole[0])) == (r.length, r.ids_crc32, r.doc_tokens)
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            n = int(g.length.sum())
            assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and (n == 2048 or n & (n - 1) == 0)


def test_empty_documents(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0
