"""Rules over grammar matches, -ward words and their overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import paragraphs

# Fixed values.
WARDS = "toward forward backward upward downward inward outward onward homeward afterward seaward landward skyward northward southward eastward westward leftward rightward".split()
WARD = r"(?iU)\b(?:" + "|".join(WARDS) + r")s?\b"
COMMA = "COMMA_COMPOUND_SENTENCE"


def kept_matches(matches: DataFrame, disabled: DataFrame | None = None, ignored: DataFrame | None = None, issue_types: list[str] | None = None) -> DataFrame:
    """matches (rule, context, issue_type, ...) but those of disabled rules (rule) or with an ignored phrase (phrase) in their context."""
    if disabled is not None:
        matches = matches.join(disabled.select(F.col("rule").alias("_r")), F.col("rule") == F.col("_r"), "left_anti")
    if ignored is not None:
        # a rule file's phrases as one array beside each match: no pairs of rows are made
        held = ignored.agg(F.collect_set("phrase").alias("_ps"))
        matches = matches.crossJoin(F.broadcast(held)).filter(~F.exists("_ps", lambda p: F.contains(F.col("context"), p))).drop("_ps")
    return matches if issue_types is None else matches.filter(F.col("issue_type").isin(issue_types))


def without_matched(house: DataFrame, matches: DataFrame) -> DataFrame:
    """House hits (doc_id, off, ...) but where any match starts, of a disabled rule too."""
    return house.join(matches.select("doc_id", "off").distinct(), ["doc_id", "off"], "left_anti")


def comma_best(matches: DataFrame) -> DataFrame:
    """Of the comma rules' matches on one context the strongest, the first of equals; other matches all. Needs an `ord` column."""
    comma = F.col("rule").startswith(COMMA)
    strength = F.when(F.col("rule") == COMMA, 0).when(F.col("rule") == f"{COMMA}_2", 1).when(F.col("rule") == f"{COMMA}_3", 2).otherwise(99)
    w = Window.partitionBy("doc_id", "context").orderBy(strength, "ord")
    best = matches.filter(comma).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return matches.filter(~comma).unionByName(best)


def comma_word(suggestion):
    """The conjunction a comma rule's suggestion is filed under."""
    return F.when(F.contains(suggestion, F.lit("but")), "but").when(F.contains(suggestion, F.lit("so")), "so").when(F.contains(suggestion, F.lit("and")), "and").otherwise("other")


def rule_counts(matches: DataFrame) -> DataFrame:
    """(rule, n), and a row of the total with a null rule."""
    return matches.rollup("rule").agg(F.count("*").alias("n"))


def ward_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, para_no, token, s, e): -ward and -wards words with their places in the paragraph."""
    p = paragraphs(docs).filter(F.col("paragraph").rlike(WARD))
    parts = F.split(F.regexp_replace("paragraph", f"{WARD}", "\ue000$0\ue001"), "\ue000")
    p = p.withColumn("_p", parts).select("doc_id", "para_no", "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("k"))
    before = F.translate(F.array_join(F.slice("_p", F.lit(1), F.col("k")), ""), "\ue001", "")
    token = F.substring_index(F.element_at("_p", F.col("k") + 1), "\ue001", 1)
    return p.select("doc_id", "para_no", token.alias("token"), F.length(before).alias("s"), (F.length(before) + F.length(token)).alias("e"))


def ward_rules(tokens: DataFrame, pos: DataFrame | None = None) -> DataFrame:
    """tokens with `rule` and `replacement` by the house's four rules.

    pos (doc_id, para_no, s, prev, next) names the parts of speech around a
    token; without it every neighbour is neither verb nor noun.
    """
    t = tokens if pos is None else tokens.join(pos, ["doc_id", "para_no", "s"], "left")
    prev, nxt = (F.lit(""), F.lit("")) if pos is None else (F.coalesce("prev", F.lit("")), F.coalesce("next", F.lit("")))
    low = F.lower("token")
    bare = F.regexp_replace(low, "s$", "")
    rule = (
        F.when(low == "toward", "toward_to_towards")
        .when((low == "forward") & (prev != "VERB") & (nxt != "NOUN"), "forward_to_forwards")
        .when(low.endswith("ward") & (low != "forward") & (nxt != "NOUN"), "ward_add_s")
        .when(low.endswith("wards") & (low != "towards") & (nxt == "NOUN"), "wards_to_ward")
    )
    return t.withColumn("rule", rule).filter("rule IS NOT NULL").withColumn("replacement", F.when(F.col("rule") == "wards_to_ward", bare).otherwise(F.concat(bare, F.lit("s")))).withColumn("advisory", F.col("rule") == "forward_to_forwards")


def ward_overlap(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """tokens with flagged and rules: matches (doc_id, para_no, ms, me, rule) that overlap the token's place."""
    m = matches.select("doc_id", "para_no", "ms", "me", "rule")
    j = tokens.join(m, ["doc_id", "para_no"], "left").withColumn("hit", F.coalesce(~((F.col("me") <= F.col("s")) | (F.col("ms") >= F.col("e"))), F.lit(False)))
    g = j.groupBy("doc_id", "para_no", "s", "e", "token").agg(F.bool_or("hit").alias("flagged"), F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("rule")))).alias("rules"))
    return g


def ward_summary(overlap: DataFrame) -> DataFrame:
    """(paragraphs, flagged, tokens, rules): one row; rules are the distinct ones that overlap."""
    rules = F.size(F.array_distinct(F.flatten(F.collect_set("rules")))).cast("long")
    return overlap.agg(F.count_distinct("doc_id", "para_no").alias("paragraphs"), F.count_if("flagged").alias("flagged"), F.count("*").alias("tokens"), rules.alias("rules"))
