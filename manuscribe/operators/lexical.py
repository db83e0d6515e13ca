"""Token rules against word lists: spelling, flag words, house spelling, L/R swaps, names, compounds, crutch words, lemmas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import close_pairs, may_reach, ratio
from ..functions.text import ASCII_WORD, UNICODE_WORD, like_case, token_array, tokens, white_words

#: Words up to this length, with as many ways to leave characters out, meet under what is left; longer ones under their parts.
LONGEST_CUT, MOST_CUTS = 24, 1200
#: So many first pieces of phrases are looked for in place; with more, every piece meets the phrases in a join.
MOST_FIRSTS = 10_000

# Fixed values.
KEEP_WORDS = ["programme", "jewellery", "kerb", "tyre", "draught", "honour", "traveller", "mould", "sombre", "armour", "rumour", "savour", "clamour", "labour", "favour", "flavour"]
CRUTCH = {"like": 80.0, "just": 60.0, "really": 40.0, "very": 30.0, "suddenly": 20.0}
LR_CONTEXT = "(?i)[aeiouy][bcdfghjkmnpqtvwxz][lr][aeiouy]"
FOCUS_LEMMAS = """smile grin smirk beam grimace frown scowl stare gaze glare glance blink squint peer wink laugh chuckle giggle scoff sob cry weep groan
moan shrug flinch shiver tremble shake shudder tense relax slump straighten lean shift sway pace freeze still sigh huff sniff snort gasp pant breathe exhale
inhale swallow gulp lick purse press clench tighten grip grasp fidget drum tap twist wring fold clasp rake whisper murmur mutter shout yell snap bark hiss
growl purr stammer stutter suddenly quietly slowly carefully really very just softly gently almost nearly slightly simply actually probably maybe perhaps
pretty totally completely absolutely definitely literally""".split()
#: Irregular forms of those lemmas.
IRREGULAR = {"shook": "shake", "shaken": "shake", "froze": "freeze", "frozen": "freeze", "wept": "weep", "wrung": "wring", "leant": "lean", "cried": "cry", "cries": "cry", "stilled": "still"}
HOUSE_SPELLING = {
    "organize": "organise", "organizing": "organising", "organizes": "organises", "organized": "organised", "recognize": "recognise", "recognizing": "recognising",
    "recognizes": "recognises", "recognized": "recognised", "realize": "realise", "realizing": "realising", "realizes": "realises", "realized": "realised",
    "emphasize": "emphasise", "emphasizing": "emphasising", "emphasizes": "emphasises", "emphasized": "emphasised", "authorize": "authorise", "authorizing": "authorising",
    "authorized": "authorised", "authorizes": "authorises", "color": "colour", "colors": "colours", "colored": "coloured", "coloring": "colouring", "honor": "honour",
    "honors": "honours", "honored": "honoured", "honoring": "honouring", "favor": "favour", "favors": "favours", "favored": "favoured", "favoring": "favouring", "odor": "odour",
    "odors": "odours", "humor": "humour", "humors": "humours", "humored": "humoured", "humoring": "humouring", "labor": "labour", "laboring": "labouring", "labored": "laboured",
    "labors": "labours", "neighbor": "neighbour", "neighbors": "neighbours", "neighboring": "neighbouring", "neighbored": "neighboured", "armor": "armour", "armored": "armoured",
    "armoring": "armouring", "rumor": "rumour", "rumors": "rumours", "savor": "savour", "savory": "savoury", "center": "centre", "centers": "centres", "meter": "metre",
    "meters": "metres", "fiber": "fibre", "fibers": "fibres", "liter": "litre", "liters": "litres", "theater": "theatre", "theaters": "theatres", "scepter": "sceptre",
    "sepulcher": "sepulchre", "defense": "defence", "offense": "offence", "pretense": "pretence", "dialog": "dialogue", "catalog": "catalogue", "analog": "analogue",
    "monolog": "monologue", "travelog": "travelogue", "canceled": "cancelled", "canceling": "cancelling", "traveler": "traveller", "travelers": "travellers",
    "traveling": "travelling", "modeled": "modelled", "modeling": "modelling", "fueling": "fuelling", "fueled": "fuelled", "counselor": "counsellor", "jeweler": "jeweller",
    "marvelous": "marvellous", "program": "programme except code", "pajamas": "pyjamas", "pajama": "pyjama", "mustache": "moustache", "curb": "kerb for pavement edge",
    "tire": "tyre for wheel", "gray": "grey", "aluminum": "aluminium", "draft": "draught for airflow", "plow": "plough", "aging": "ageing", "encyclopedia": "encyclopaedia",
    "maneuver": "manoeuvre", "archeology": "archaeology", "artifact": "artefact", "mold": "mould", "sulfur": "sulphur", "ax": "axe", "jeweled": "jewelled", "enroll": "enrol",
    "enrollment": "enrolment", "whiskey": "whisky except Irish whiskey",
}


def table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small literal table."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def house_spelling(docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, token, suggestion, n): words spelled against the house's list; pairs is (wrong, preferred)."""
    pairs = table(docs.sparkSession, list(HOUSE_SPELLING.items()), ("wrong", "preferred")) if pairs is None else pairs
    t = tokens(docs, "text", "doc_id", pattern=r"(?U)\w+").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return t.join(pairs, F.lower("token") == F.col("wrong")).select("doc_id", "token", like_case(F.col("token"), F.col("preferred")).alias("suggestion"), "n")


def spelling_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token): words to check; brackets are comments, curly apostrophes straight, numbers and capitals left out."""
    clean = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)\[.*?\]", ""), "’", "'")
    t = tokens(docs.select("doc_id", clean.alias("_t")), "_t", "doc_id", pattern=UNICODE_WORD)
    tok = F.col("token")
    return t.filter(~tok.rlike("^[0-9.,%]+$") & ~((tok == F.upper(tok)) & (tok != F.lower(tok))))


def base_form(w: Column) -> Column:
    """Without a possessive, else without a plural s."""
    n = F.length(w)
    return F.when(w.rlike("'s$"), w.substr(F.lit(1), n - 2)).when(w.rlike("s$") & (n > 3), w.substr(F.lit(1), n - 1)).otherwise(w)


def unknown_words(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token_lower, n, docs): words that neither the lexicon (word) has nor their base form."""
    counts = spelling_tokens(docs).groupBy(F.lower("token").alias("token_lower")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    known = lexicon.select(F.lower("word").alias("word")).distinct()
    left = counts.join(known, F.col("token_lower") == F.col("word"), "left_anti").withColumn("base", base_form(F.col("token_lower")))
    return left.join(known, F.col("base") == F.col("word"), "left_anti").drop("base")


def suggestions(unknown: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """(token_lower, suggestion, distance): nearest word of the lexicon (word, n) within `most` edits, with the same first letter and a length within `most`."""
    lex = lexicon.select(F.lower("word").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("freq"))
    right = lex.select(F.struct("word", "freq").alias("key"), "word", F.substring("word", 1, 1).alias("first"))
    left = unknown.select(F.col("token_lower").alias("key"), F.col("token_lower").alias("word"), F.substring("token_lower", 1, 1).alias("first"))
    # a replaced letter is one edit here: it leaves one character of both words out, and all parts but one whole
    pair = close_pairs(left, right, lambda n, m: F.greatest(n, m) - most, lambda n, m: F.lit(most), lambda m: m - most, lambda m: m + most, most, LONGEST_CUT)
    near = pair.select("lkey", F.col("rkey.word").alias("word"), F.col("rkey.freq").alias("freq"), F.levenshtein("lkey", "rkey.word", most).alias("distance")).filter(f"distance BETWEEN 1 AND {most}")
    return near.groupBy(F.col("lkey").alias("token_lower")).agg(F.min(F.struct("distance", -F.col("freq"), "word")).alias("b")).select("token_lower", F.col("b.word").alias("suggestion"), F.col("b.distance").alias("distance"))


def flag_words(docs: DataFrame, rules: DataFrame, allowed: DataFrame | None = None, phrases: bool = False) -> DataFrame:
    """(doc_id, token, suggestion, n): tokens that `rules` (wrong_lower, right) flags, but upper-case entries of `allowed` (word).

    Single tokens only, so keys of several words never match, unless `phrases`.
    """
    t = spelling_tokens(docs).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    if allowed is not None:
        t = t.join(allowed.filter("word = upper(word) AND word <> lower(word)").select(F.lower("word").alias("_w")), F.lower("token") == F.col("_w"), "left_anti")
    out = t.join(rules, F.lower("token") == F.col("wrong_lower")).select("doc_id", "token", F.col("right").alias("suggestion"), "n")
    if not phrases:
        return out
    many = phrase_hits(docs, rules.filter("wrong_lower LIKE '% %'").select(F.col("wrong_lower").alias("phrase"), F.col("right").alias("suggestion")))
    return out.unionByName(many.select("doc_id", F.col("phrase").alias("token"), "suggestion", "n"))


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase and the other columns of `phrases`, n): whole-word hits in any case.

    Texts are cut into words and the characters between them, so that a phrase
    matches only where its own separators stand. Where a phrase's first piece
    stands, as many pieces as the longest phrase has are compared; only these
    leave the text. `phrases` is a rule table.
    """
    pieces = r"(?U)[\w]+|[^\w]+"
    cut = lambda c: F.regexp_extract_all(F.lower(c), F.lit(pieces), F.lit(0))
    p = phrases.withColumn("_parts", cut(F.col("phrase"))).withColumn("_first", F.element_at("_parts", 1))
    longest = max(p.agg(F.max(F.size("_parts"))).first()[0] or 0, 1)
    firsts = [r[0] for r in p.select("_first").filter("_first IS NOT NULL").distinct().limit(MOST_FIRSTS + 1).collect()]
    starts = lambda x: x.isin(firsts) if len(firsts) <= MOST_FIRSTS else F.lit(True)
    rows = docs.select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("_t"))
    ahead = F.transform("_t", lambda x, i: F.when(starts(x), F.slice("_t", i + 1, F.lit(longest))))
    near = rows.select("doc_id", F.explode(F.filter(ahead, lambda x: x.isNotNull())).alias("_ahead")).withColumn("_first", F.element_at("_ahead", 1))
    hit = near.join(p, "_first").filter(F.slice("_ahead", F.lit(1), F.size("_parts")) == F.col("_parts"))
    return hit.groupBy("doc_id", *phrases.columns).agg(F.count("*").alias("n"))


def lr_swaps(docs: DataFrame, lexicon: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, token_lower, suggestion, n): unknown words that a swap of l and r between vowel, consonant and vowel makes known."""
    t = tokens(docs, "text", "doc_id", pattern=ASCII_WORD).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    low = F.lower("token")
    t = t.filter((F.length("token") >= 4) & ~F.col("token").rlike("^[A-Z][a-z]+$") & ~low.rlike("^[lr]") & ~low.isin(*(KEEP_WORDS if keep is None else keep)))
    t = t.groupBy("doc_id", low.alias("token_lower")).agg(F.sum("n").alias("n"))
    known = lexicon.select(F.lower("word").alias("word")).distinct()
    words = t.select("token_lower").distinct().filter(F.col("token_lower").rlike(LR_CONTEXT)).join(known, F.col("token_lower") == F.col("word"), "left_anti")
    marked = F.split(F.regexp_replace("token_lower", LR_CONTEXT, "\ue000$0"), "\ue000")
    words = words.withColumn("_p", marked).select("token_lower", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("k"), "_p")
    before = F.concat(F.array_join(F.slice("_p", F.lit(1), F.col("k")), ""), F.substring(F.element_at("_p", F.col("k") + 1), 1, 2))
    at = F.length(before) + 1
    swapped = words.withColumn("i", at).select("token_lower", F.expr("concat(substring(token_lower, 1, i - 1), CASE substring(token_lower, i, 1) WHEN 'l' THEN 'r' ELSE 'l' END, substring(token_lower, i + 1, length(token_lower)))").alias("swapped"), "i")
    found = swapped.join(known, F.col("swapped") == F.col("word"), "left_semi").groupBy("token_lower").agg(F.min_by("swapped", "i").alias("suggestion"))
    return t.join(found, "token_lower").select("doc_id", "token_lower", "suggestion", "n")


def capitalised(docs: DataFrame, least: int = 3) -> DataFrame:
    """(token_lower, n, docs): capitalised words."""
    t = tokens(docs, "text", "doc_id", pattern=ASCII_WORD).filter(F.col("token").rlike("^[A-Z]") & (F.length("token") >= least))
    return t.groupBy(F.lower("token").alias("token_lower")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def name_drift(names: DataFrame, similarity: float = 90.0, canonical: int = 3, variant: int = 2) -> DataFrame:
    """(canonical, variant, canonical_n, variant_n, score) of names (token_lower, n): rare forms close to a common one with the same first letter.

    The ratio leaves room for (1 - similarity / 100) of both lengths in
    insertions and deletions, so words meet under what these leave of them.
    """
    t = similarity / 100
    c = names.filter(F.col("n") >= canonical).select(F.col("token_lower").alias("canonical"), F.col("n").alias("canonical_n"))
    v = names.filter(F.col("n") <= variant).select(F.col("token_lower").alias("variant"), F.col("n").alias("variant_n"))
    keyed = [d.select(F.col(w).alias("key"), F.col(w).alias("word"), F.substring(w, 1, 1).alias("first")) for d, w in ((v, "variant"), (c, "canonical"))]
    room = lambda n, m: F.floor((n + m) * (1 - t) + 1e-9)
    cut = max((n for n in range(1, LONGEST_CUT + 1) if math.comb(n - 1, n - math.ceil(n * t / (2 - t) - 1e-9)) <= MOST_CUTS), default=0)
    pairs = close_pairs(
        *keyed, lambda n, m: F.ceil((n + m) * t / 2 - 1e-9), room, lambda m: F.ceil(m * t / (2 - t) - 1e-9), lambda m: F.floor(m * (2 - t) / t + 1e-9), cut - math.ceil(cut * t / (2 - t) - 1e-9), cut
    )
    pairs = pairs.distinct().filter(may_reach(F.col("lkey"), F.col("rkey"), similarity)).withColumn("score", ratio("rkey", "lkey")).filter(F.col("score") >= similarity - 1e-9)
    return pairs.join(c, F.col("rkey") == F.col("canonical")).join(v, F.col("lkey") == F.col("variant")).select("canonical", "variant", "canonical_n", "variant_n", "score")


def drift_groups(drift: DataFrame) -> DataFrame:
    """(canonical, canonical_n, variants): each canonical name's variants as structs (variant, variant_n, score), most frequent and then closest first."""
    order = F.struct((-F.col("variant_n")).alias("_n"), (-F.col("score")).alias("_s"), "variant", "variant_n", "score")
    g = drift.groupBy("canonical", "canonical_n").agg(F.array_sort(F.collect_list(order)).alias("v"))
    return g.select("canonical", "canonical_n", F.transform("v", lambda x: F.struct(x["variant"].alias("variant"), x["variant_n"].alias("variant_n"), x["score"].alias("score"))).alias("variants"))


def crutch_overview(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(word, n, total_words, per_10k, guideline, above) of rules (word, guideline); one scan, and nothing but the rules' words is shuffled."""
    said = docs.select(F.size(white_words(F.col("text"))).alias("_w"), token_array(F.col("text"), r"(?U)\w+").alias("_ts"))
    said = said.select("_w", F.posexplode_outer("_ts").alias("_p", "_t"))
    named = said.join(rules.select(F.col("word").alias("_word")), F.lower("_t") == F.col("_word"), "left")
    counts = named.groupBy("_word").agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("_w"))).alias("_all"))
    total = counts.agg(F.sum("_all").alias("total_words"))
    out = rules.join(counts.select(F.col("_word").alias("word"), "n"), "word", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    rate = F.try_divide(F.col("n") * 10000.0, "total_words")
    return out.select("word", "n", "total_words", rate.alias("per_10k"), "guideline", (F.coalesce(rate, F.lit(0.0)) > F.col("guideline")).alias("above"))


def word_rate(docs: DataFrame, word: str) -> DataFrame:
    """(doc_id, words, n, per_1k) of one word."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?iU)\b{word}\b"), F.lit(0)))
    d = docs.select("doc_id", F.size(white_words(F.col("text"))).cast("long").alias("words"), n.cast("long").alias("n"))
    return d.withColumn("per_1k", F.try_divide(F.col("n") * 1000.0, "words"))


def inflections(lemmas: list[str] | None = None) -> dict[str, str]:
    """Every regular form of the lemmas, and the irregular ones listed."""
    out: dict[str, str] = {}
    for w in FOCUS_LEMMAS if lemmas is None else lemmas:
        stem = w[:-1] if w.endswith("e") else w
        twice = w + w[-1] if len(w) > 2 and w[-1] in "bdgmnprt" and w[-2] in "aeiou" and w[-3] not in "aeiou" else stem
        for form in (w, w + "s", w + "es" if w[-1] in "hsx" else w, stem + "ed", stem + "ing", twice + "ed", twice + "ing"):
            out.setdefault(form, w)
    return out | {k: v for k, v in IRREGULAR.items() if v in (FOCUS_LEMMAS if lemmas is None else lemmas)}


def lemma_counts(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """(lemma, doc_id, n) of forms (form, lemma)."""
    t = tokens(docs, "text", "doc_id", pattern=r"(?U)\p{L}+").groupBy("doc_id", F.lower("token").alias("form")).agg(F.count("*").alias("n"))
    return t.join(forms, "form").groupBy("lemma", "doc_id").agg(F.sum("n").alias("n"))


def lemma_concentration(counts: DataFrame, total: int = 25, chapter: int = 6, share: float = 0.25) -> DataFrame:
    """(lemma, total, top_doc, top_n, share): lemmas bunched in one chapter; ties go to the earlier."""
    g = counts.groupBy("lemma").agg(F.sum("n").alias("total"), F.max_by(F.struct("doc_id", "n"), F.struct("n", -F.col("doc_id"))).alias("top"))
    g = g.select("lemma", "total", F.col("top.doc_id").alias("top_doc"), F.col("top.n").alias("top_n"), (F.col("top.n") / F.col("total")).alias("share"))
    return g.filter((F.col("total") >= total) & (F.col("top_n") >= chapter) & (F.col("share") >= share))


def compound_counts(docs: DataFrame, families: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """(family, preferred_n, variant, variant_n) of families (family, alts) with a variant in use."""
    if whitelist is not None:
        families = families.join(whitelist.select(F.lower("word").alias("_w")), F.lower("family") == F.col("_w"), "left_anti")
    forms = families.select("family", F.col("family").alias("phrase"), F.lit(True).alias("preferred")).unionByName(families.select("family", F.explode("alts").alias("phrase"), F.lit(False).alias("preferred")))
    hits = phrase_hits(docs, forms).groupBy("family", "phrase", "preferred").agg(F.sum("n").alias("n"))
    pref = hits.filter("preferred").select("family", F.col("n").alias("preferred_n"))
    return hits.filter("NOT preferred").join(pref, "family", "left").select("family", F.coalesce("preferred_n", F.lit(0)).alias("preferred_n"), F.col("phrase").alias("variant"), F.col("n").alias("variant_n"))


def simile_repeats(similes: DataFrame, window: int = 8) -> DataFrame:
    """(phrase, n, least_gap): similes (phrase, chapter) in two chapters closer than the window."""
    n = similes.groupBy("phrase").agg(F.count("*").alias("n"))
    d = similes.distinct().withColumn("gap", F.col("chapter") - F.lag("chapter").over(Window.partitionBy("phrase").orderBy("chapter")))
    return d.groupBy("phrase").agg(F.min("gap").alias("least_gap")).filter(F.col("least_gap") < window).join(n, "phrase").filter("n >= 2").select("phrase", "n", "least_gap")


def similes(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(phrase, chapter): "like", determiners and describing words, and the noun, found by a pattern; doc_id is the chapter.

    The noun's plural s is dropped; `groups` (phrase, key) merges phrases.
    """
    t = docs.select(F.col("doc_id").alias("chapter"), F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\blike\s+((?:(?:a|an|the|some)\s+)\p{L}+)\b"), F.lit(1))).alias("noun"))
    noun = F.regexp_replace(F.regexp_replace("noun", r"^(a|an|the|some)\s+", ""), "(?<=[^s]{3})s$", "")
    t = t.select("chapter", F.concat(F.lit("like "), noun).alias("phrase"))
    if groups is not None:
        t = t.join(groups, "phrase", "left").select("chapter", F.coalesce("key", "phrase").alias("phrase"))
    return t.select("phrase", "chapter")
