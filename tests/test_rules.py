import io
import zipfile

import pytest
from pyspark.sql import functions as F

from manuscribe.functions.similarity import lcs, native_ratio
from manuscribe.functions.text import lines
from manuscribe.operators import chapters, lexical, phrases, structure
from manuscribe.sources import docx, rules


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


CASES = {
    "double_space": (["a  b"], ["a b", "a\tb"]),
    "editing_marker": (["x [[ y", "<<", "NOTE: z"], ["note: z", "<"]),
    "split_year": (["in 19 84."], ["in 1984", "219 84"]),
    "spaced_hyphen": (["a - b"], ["a-b", "- b"]),
    "em_dash_spacing": (["a — b", "a— b"], ["a—b"]),
    "bad_ellipsis": (["a...", "a….", "……"], ["a…", "a.."]),
    "title_period": (["Mr. A", "DR. B"], ["Mr A", "Emr. x"]),
    "time_periods": (["5 p.m.x"], ["at 5 p.m. now"]),
    "contraction_quote": (["x‘Twas so"], ["‘Twas so"]),
    "amid": (["Amid it"], ["amidst"]),
    "non_british_date": (["May 3rd, 1999", "3/4/99", "Monday, May 4"], ["3 May 1999"]),
    "en_dash": (["é–b"], ["1–2", "a–b"]),
    "multi_punct": (["so !!!", "What!!!!", "x ...."], ["What!!!", "so !!!”"]),
    "smart_single_open": (["a ‘b"], ["a ‘b’"]),
    "straight_double_odd": (['a "b'], ['"a"']),
    "straight_single_odd": (["a ' b"], ["don't", "'80s", "dogs' x"]),
    "ellipsis_start_space": (["… so", "“… so"], ["…so"]),
    "ellipsis_space_before": (["a …b"], ["a…"]),
    "ellipsis_comma_after": (["a…,b"], ["a…, b", "a…,” b"]),
    "ellipsis_no_space_after": (["a…b"], ["a… b", "a…?"]),
}


def test_line_rules(spark):
    texts = [(rule, hit, t) for rule, (hits, misses) in CASES.items() for hit, group in ((True, hits), (False, misses)) for t in group]
    found = {(r["type"], r["doc_id"]) for r in structure.line_issues(lines(docs(spark, *[t for _, _, t in texts]))).collect()}
    for i, (rule, hit, t) in enumerate(texts):
        assert ((rule, i) in found) == hit, (rule, t)


def test_intended_variants(spark):
    found = {r["type"] for r in structure.line_issues(lines(docs(spark, "at 5 p.m. now\n‘Twas so")), intended=True).collect()}
    assert {"time_periods", "contraction_quote"} <= found


def test_repeated_words_pair_up(spark):
    d = docs(spark, "go go", "go go go", "Go go GO go", "go, go", "", None)
    got = {r["doc_id"]: r["n"] for r in structure.repeated_words(lines(d)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def test_windows_over_lines(spark):
    d = docs(spark, "yes,\nbut no.\nyes,\nwe go", "“open\n\ngo on\nx” y”", "one two three four five six seven eight nine ten\n\nshort")
    comma = {(r["doc_id"], r["line_no"]) for r in structure.line_end_comma(lines(d)).collect()}
    assert comma == {(0, 3)}
    quotes = {(r["type"], r["doc_id"], r["line_no"]) for r in structure.quote_state(lines(d)).collect()}
    assert quotes == {("continued_without_quote", 1, 3), ("stray_closing_quote", 1, 4)}
    ends = {(r["doc_id"], r["line_no"]) for r in structure.paragraph_no_terminal(lines(d)).collect()}
    assert ends == {(2, 1)}


@pytest.mark.parametrize(("a", "b", "want"), [("treggan", "treggen", 85.714285714), ("maurice", "muarice", 85.714285714), ("abc", "abc", 100), ("", "", 100), ("abc", "xyz", 0)])
def test_ratio(spark, a, b, want):
    if a:
        assert 200 * lcs(a, b) / (len(a) + len(b)) == pytest.approx(want)
    assert spark.range(1).select(native_ratio(F.lit(a), F.lit(b))).first()[0] == pytest.approx(want)


def test_near_phrases_against_all_pairs(spark):
    base = ["the quick brown fox jumps over it", "the quick brown fox jumps over at", "quick the brown fox jumps over it", "a very different line of words here"]
    got = {frozenset((r["phrase_a"], r["phrase_b"])) for r in phrases.near_repeats(phrases.phrase_lines(docs(spark, "\n".join(base)))).collect()}
    want = set()
    for i, a in enumerate(base):
        for b in base[i + 1 :]:
            x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
            if 200 * lcs(x, y) / (len(x) + len(y)) >= 95:
                want.add(frozenset((a, b)))
    assert got == want and got


def test_near_phrases_with_wide_inner_spacing(spark):
    wide = "Chapter One" + " " * 16 + "Two" + " " * 17 + "Three"
    got = phrases.near_repeats(phrases.phrase_lines(docs(spark, "Chapter One Two Three", f"x\n{wide}"))).collect()
    assert [(r["phrase_a"], r["phrase_b"], r["score"]) for r in got] == [("Chapter One Two Three", wide, 100.0)]


def test_lr_swap(spark):
    lex = lexical.table(spark, [("secretary",), ("salon",)], ("word",))
    got = lexical.lr_swaps(docs(spark, "a secletary and secretary", "secretary"), lex).collect()
    assert [(r["doc_id"], r["token_lower"], r["suggestion"]) for r in got] == [(0, "secletary", "secretary")]


def test_chapters(spark):
    rows = [("b", i, t) for i, t in enumerate(["before", "Chapter 2: x", "two", "Rule #1", "one", "Chapter 2", "again", "Epilogue", "end"])]
    seg = chapters.segments(spark.createDataFrame(rows, "book string, para_idx long, text string"))
    got = {r["file_name"]: r["body"] for r in chapters.chapters(seg).collect()}
    assert got == {"preamble.txt": "before", "chapter_001.txt": "one", "chapter_002.txt": "again", "chapter_003.txt": "end"}
    assert [r["para_idx"] for r in chapters.duplicate_numbers(seg).collect()] == [5]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Odd"/></w:pPr><w:r><w:rPr><w:highlight w:val="yellow"/></w:rPr><w:t>a</w:t><w:br/><w:t>"b</w:t></w:r></w:p></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "book.docx").write_bytes(buf.getvalue())
    (tmp_path / "fake.docx").write_bytes(b"")
    r = docx.runs(spark, str(tmp_path))
    types = {x["type"] for x in chapters.artefacts(r).collect()}
    assert types == {"unknown_style", "highlight", "line_break", "straight_double_quote"}
    assert docx.paragraphs(r).first()["text"] == 'a\x0b"b'


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\none\n#INCLUDE b.txt\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("two\n#include a.txt\n", encoding="utf-8")
    assert sorted(r["word"] for r in rules.lexicon(spark, tmp_path / "a.txt").collect()) == ["one", "two"]
    (tmp_path / "f.txt").write_text("Co-op <= coop, co op\nbad line\n", encoding="utf-8")
    assert rules.families(spark, tmp_path / "f.txt").first()["alts"] == ["coop", "co op"]
    assert rules.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_lemma_forms():
    forms = lexical.inflections()
    assert forms["smiling"] == "smile" and forms["grinned"] == "grin" and forms["shook"] == "shake" and forms["presses"] == "press"


def test_queries_have_rows_and_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    from manuscribe.plans import queries as plans

    for name in ("repeated_word", "quote_state", "ellipsis_spacing", "lr_confusion", "crutch_overview", "chapter_segments", "spell_suggest"):
        got = plans.QUERIES[name](spark, sf).toPandas()
        want = con.execute(plans.ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        key = lambda d, cols=cols: sorted(map(str, d[cols].round(9).values.tolist()))
        assert key(got) == key(want), name
        assert len(got), name
    assert entry.entry(spark).count() == len(plans.CRUTCH)


def test_close_words_meet_whatever_their_length(spark):
    """Names and suggestions against all pairs, long forms and edits at both ends included."""
    import random

    from manuscribe.functions.similarity import lcs

    rng = random.Random(4)
    names = {"".join(rng.choice("abcde") for _ in range(rng.choice((3, 4, 6, 9, 14, 45)))) for _ in range(60)}
    for w in sorted(names):
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(1, 3 + len(x) // 6)):
                i = rng.randrange(1, len(x) + 1)
                x[i : i + rng.randrange(2)] = rng.choice([[], ["a"], ["e", "b"]])
            names.add("".join(x))
    names |= {"k" * 45, "k" * 55}
    counts = {w: 5 if i % 2 else 1 for i, w in enumerate(sorted(names - {""}))} | {"k" * 45: 5, "k" * 55: 1}
    rows = spark.createDataFrame(list(counts.items()), "token_lower string, n long")
    want = {(c, v) for c, n in counts.items() if n >= 3 for v, m in counts.items() if m <= 2 and c[0] == v[0] and 200 * lcs(c, v) >= 90 * (len(c) + len(v))}
    got = lexical.name_drift(rows).collect()
    assert {(r["canonical"], r["variant"]) for r in got} == want and ("k" * 45, "k" * 55) in want and len(got) == len(want)

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    lex = sorted(w for w in names if w and counts.get(w) == 5)
    unknown = sorted(w for w in names if w and counts.get(w) == 1)
    best = {}
    for u in unknown:
        near = [(d, w) for w in lex if w[0] == u[0] and abs(len(w) - len(u)) <= 2 and 1 <= (d := edits(u, w)) <= 2]
        if near:
            best[u] = min(near)
    out = lexical.suggestions(spark.createDataFrame([(u,) for u in unknown], "token_lower string"), spark.createDataFrame([(w, 1) for w in lex], "word string, n long")).collect()
    assert {r["token_lower"]: (r["distance"], r["suggestion"]) for r in out} == best


def test_close_words_meet_by_what_they_have_in_common(spark):
    """Short words, and words on both sides of the length from which parts are compared; words that merely share parts do not meet."""
    from manuscribe.functions.similarity import close_pairs

    lex = ["ab", "a", "abc", "x" + "ab" * 11 + "c", "x" + "ab" * 12]
    out = lexical.suggestions(spark.createDataFrame([("ac",), ("x" + "ab" * 11 + "cde",), ("x" + "ab" * 11,)], "token_lower string"), spark.createDataFrame([(w, 1) for w in lex], "word string, n long")).collect()
    assert {r["token_lower"]: (r["suggestion"], r["distance"]) for r in out} == {"ac": ("a", 1), "x" + "ab" * 11 + "cde": ("x" + "ab" * 11 + "c", 2), "x" + "ab" * 11: ("x" + "ab" * 11 + "c", 1)}
    names = {"k" + "abcdefghijklmnopqrst": 5, "k" + "abcdefghijklmnopqrstuvwx": 1}
    got = lexical.name_drift(spark.createDataFrame(list(names.items()), "token_lower string, n long")).collect()
    assert [(r["canonical"], r["variant"]) for r in got] == [tuple(names)]

    syllables = ["th", "on", "er", "an", "in", "re", "ou", "st"]
    words = ["th" + a + b + c for a in syllables for b in syllables for c in syllables]
    keyed = [spark.createDataFrame([(w, w, w[0]) for w in ws], "key string, word string, first string") for ws in (words[::2], words[1::2])]
    met = close_pairs(*keyed, lambda n, m: F.greatest(n, m) - 1, lambda n, m: F.lit(1), lambda m: m - 1, lambda m: m + 1, 1, 24).distinct().collect()
    assert met and all(lcs(r["lkey"], r["rkey"]) >= 7 for r in met)


def generated(df):
    """The columns that the plan's explodes carry along."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#.*", "", c.strip()) for at in re.findall(r"Generate .*\), \[([^\]]*)\], (?:true|false), \[", plan) for c in at.split(",")}


def test_phrases_do_not_carry_texts_along(spark):
    """A hit's row holds the pieces ahead, not its whole text; hits are those of neighbours, ends and other separators."""
    d = docs(spark, "Of the of the, of  the OF THE", "of the", "the of", None, "")
    got = lexical.phrase_hits(d, lexical.table(spark, [("of the",), ("the of the",), ("the",)], ("phrase",)))
    assert {(r["doc_id"], r["phrase"]): r["n"] for r in got.collect()} == {(0, "of the"): 3, (0, "the of the"): 2, (0, "the"): 4, (1, "of the"): 1, (1, "the"): 1, (2, "the"): 1}
    assert "_t" not in generated(got)


def test_first_lines_of_words(spark):
    """The first different lines of each word, repeated rows and ids included, without a copy of a line for each of its words."""
    from manuscribe.operators import contexts

    rows = [(1, "The A cat The\nthe\nThe end"), (1, "The A cat The\nthe\nThe end"), (0, "Cat and The"), (2, "The last")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = contexts.first_lines(lines(d), lambda x: x.rlike("^[A-Z]") & (F.length(x) >= 3), most=3)
    want = {("the", 1, 0, 1, "Cat and The"), ("the", 2, 1, 1, "The A cat The"), ("the", 3, 1, 3, "The end"), ("cat", 1, 0, 1, "Cat and The")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "line" not in generated(got)


def test_contexts_of_words_in_one_pass(spark):
    """First sentences, longer words, heads, and texts that are null, missing or full of odd words; words are not shuffled."""
    from manuscribe.operators import contexts

    long = "x " * 100
    d = docs(spark, "One the. Two The-n! The end. \u2014 Dash it.", f"{long}leather {long}", None, "  plain text ")
    hits = spark.createDataFrame([(0, "The"), (0, "then"), (0, "..."), (0, "it"), (1, "eat"), (2, "a"), (3, "zz"), (7, "b")], "doc_id long, word string")
    out = contexts.by_word(hits, d)
    want = {(0, "The"): "One the.", (0, "then"): "Two The-n!", (0, "..."): "One the. Two The-n! The end.   Dash it.", (0, "it"): "Dash it.", (1, "eat"): (long[-60:] + "leather " + long)[:120].strip(), (2, "a"): "", (3, "zz"): "plain text", (7, "b"): ""}
    assert {(r["doc_id"], r["word"]): r["context"] for r in out.collect()} == want
    assert generated(out) <= {"doc_id"}


def test_near_phrases_across_bands_and_chunks(spark, monkeypatch):
    """All pairs of lines of many lengths, in one chunk and in several; tokens are not listed for a join."""
    import random

    rng, text = random.Random(5), []
    for _ in range(60):
        base = [rng.choice(["an", "the", "of", "wolf", "heron", "stone", "rivers"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(4, 40))]
        text.append(" ".join(base))
        for _ in range(3):
            ws = base[:]
            for _ in range(rng.randrange(1, 3)):
                ws[rng.randrange(len(ws))] += rng.choice(["x", "y", " a", "."])
            text.append(" ".join(ws))
    text = sorted({x for x in text if len(x) >= 15})
    key = [(" ".join(sorted(x.split())), set(x.split())) for x in text]
    want = {
        frozenset((text[i], text[j])) for i, (a, s) in enumerate(key) for j, (b, t) in enumerate(key[:i]) if len(s & t) >= 0.6 * min(len(s), len(t)) - 1e-9 and 200 * lcs(a, b) >= 95 * (len(a) + len(b)) - 1e-9
    }
    for most in (150_000, 10):
        monkeypatch.setattr(phrases, "MOST_PHRASES", most)
        out = phrases.near_repeats(phrases.phrase_lines(docs(spark, "Chapter 1\n" + "\n".join(text[::2]), "\n".join(text[1::2]), None)))
        got = [frozenset((r["phrase_a"], r["phrase_b"])) for r in out.collect()]
        assert set(got) == want and len(got) == len(want) > 60
        assert not generated(out) & {"key", "size"}


def test_a_line_of_closers_ends_no_sentence(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven.\n\u201d)"), (2, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    assert [r["doc_id"] for r in structure.paragraph_no_terminal(lines(docs)).collect()] == [2]


def test_chapter_files_decode(spark, tmp_path):
    from manuscribe.sources import chapters as files

    (tmp_path / "b" / "chapters").mkdir(parents=True)
    (tmp_path / "b" / "chapters" / "chapter_002.txt").write_bytes(b"two \xff end")
    (tmp_path / "b" / "chapters" / "chapter_001.txt").write_text("\u00e9t\u00e9\n", encoding="utf-8")
    rows = lambda how: [(r["book"], r["chapter_name"], r["doc_id"], r["text"]) for r in files.chapters(spark, str(tmp_path), how).orderBy("doc_id").collect()]
    assert rows("replace") == [("b", "chapter_001.txt", 0, "\u00e9t\u00e9\n"), ("b", "chapter_002.txt", 1, "two \ufffd end")]
    assert rows("ignore")[1][3] == "two  end"
    with pytest.raises(Exception, match="(?i)utf"):
        rows("strict")
