"""Queries over whole tables, one per operator, with SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, embedding_dedup, license_scan, lm_score, minhash, packing, quality, token_count, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 85 % alike."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors with a cosine of 0.9 or more."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    return warc.archive(_table(spark, sf_dir, "pages"))


def op4_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 2,048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document, losses to 6 places; the target is what is labelled good and not toxic."""
    good = _table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    out = lm_score.score(_table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "score")])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, similarities to 6 places."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_chat_format,
        op3_warc,
        op4_lexical_packing,
        op5_minhash_near_dedup,
        op6_lm_score,
        op7_quality,
        op8_license_scan,
        op9_decontamination,
        op10_token_counts,
    )
}
_TEMPLATES = ", ".join(f"({i}, '{name}', '" + text.replace("'", "''") + "')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
_LETTERS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_SETS = """w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    u AS (SELECT doc_id, unnest(s) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN s sa ON a = sa.doc_id JOIN s sb ON b = sb.doc_id WHERE 100 * i >= 85 * (len(sa.s) + len(sb.s) - i))"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a)
        SELECT n AS vec_id, (SELECT count(*) FROM l WHERE l.a = n) AS n_links, min(c) AS component_id, n = min(c) AS kept FROM r GROUP BY n""",
    "op2_chat_format": """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM t GROUP BY conv_id),
        k AS (SELECT conv_id, l, (SELECT count(*) FROM c o WHERE o.l = c.l) AS copies FROM c
              WHERE NOT EXISTS (SELECT 1 FROM c o WHERE (len(o.l) > len(c.l) AND o.l[1:len(c.l)] = c.l) OR (o.l = c.l AND o.conv_id < c.conv_id))),
        b AS (SELECT t.conv_id, turn // 256 AS block, count(*) AS n_rows, any_value(copies) AS copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat FROM t JOIN k USING (conv_id) GROUP BY 1, 2)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS part, n_rows, copies, chat FROM b""",
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(url, 'urn:page:' || page_id) AS url FROM pages), d AS (SELECT *, strlen(h) AS b, sha256(h) AS d FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM d)
        SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN b >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN b >= 100 AND page_id <> first THEN first END AS refers_to, regexp_replace(url, '[\\x00-\\x20]', '%20', 'g') AS target_uri FROM f""",
    "op6_lm_score": """WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0) AS target FROM documents),
        k AS (SELECT doc_id, target, unnest(w) AS word, unnest(list_prepend(NULL, w[1:len(w) - 1])) AS prev FROM w WHERE len(w) > 0),
        ow AS (SELECT doc_id, word, count(*) AS n FROM k GROUP BY ALL), ob AS (SELECT doc_id, prev, word, count(*) AS n FROM k WHERE prev IS NOT NULL GROUP BY ALL),
        cw AS (SELECT word, count(*) AS b, count_if(target) AS t FROM k GROUP BY ALL), cb AS (SELECT prev, word, count(*) AS b, count_if(target) AS t FROM k WHERE prev IS NOT NULL GROUP BY ALL),
        s AS (SELECT count(*) AS v, sum(b) AS b, sum(t) AS t FROM cw), d AS (SELECT doc_id, len(w) AS n FROM w),
        g AS (SELECT ob.doc_id, ob.prev, ob.word, ob.n AS ob, cb.b AS b, cb.t AS t FROM ob JOIN cb USING (prev, word)),
        j AS (SELECT k.doc_id, k.prev, s.v, d.n, w1.b - o1.n AS wb, w1.t - CASE WHEN target THEN o1.n ELSE 0 END AS wt, w2.b - o2.n AS pb, w2.t - CASE WHEN target THEN o2.n ELSE 0 END AS pt,
            g.b - g.ob AS gb, g.t - CASE WHEN target THEN g.ob ELSE 0 END AS gt, greatest(s.b - d.n, 1) AS nb, greatest(s.t - CASE WHEN target THEN d.n ELSE 0 END, 1) AS nt
            FROM k JOIN d USING (doc_id) JOIN ow o1 ON o1.doc_id = k.doc_id AND o1.word = k.word JOIN cw w1 ON w1.word = k.word
            LEFT JOIN ow o2 ON o2.doc_id = k.doc_id AND o2.word = k.prev LEFT JOIN cw w2 ON w2.word = k.prev LEFT JOIN g ON g.doc_id = k.doc_id AND g.prev = k.prev AND g.word = k.word CROSS JOIN s),
        l AS (SELECT doc_id, avg(-ln(0.6::DOUBLE * CASE WHEN pt > 0 THEN gt::DOUBLE / pt ELSE wt::DOUBLE / nt END + 0.3::DOUBLE * (wt::DOUBLE / nt) + 0.1::DOUBLE / v)) AS t,
            avg(-ln(0.6::DOUBLE * CASE WHEN pb > 0 THEN gb::DOUBLE / pb ELSE wb::DOUBLE / nb END + 0.3::DOUBLE * (wb::DOUBLE / nb) + 0.1::DOUBLE / v)) AS b FROM j GROUP BY doc_id)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_tokens, round(l.t, 6) AS ce_target, round(l.b, 6) AS ce_background, round(l.t - l.b, 6) AS score FROM d LEFT JOIN l USING (doc_id)""",
    "op5_minhash_near_dedup": f"""WITH RECURSIVE {_SETS}, r AS (SELECT doc_id AS n, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a)
        SELECT n AS doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(c) AS component_id, n = min(c) AS kept FROM r JOIN s ON s.doc_id = n GROUP BY n""",
    # every window that starts at a multiple of a template's length, by exact containment
    "op8_license_scan": rf"""WITH t(template_id, license, text) AS (VALUES {_TEMPLATES}), tw AS (SELECT template_id, license, {_LETTERS.format("text")} AS w FROM t), tl AS (SELECT *, len(w) AS len, least(len(w), 5) AS n FROM tw WHERE len(w) > 0),
        tg AS MATERIALIZED (SELECT DISTINCT template_id, len, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len - n + 2)) AS i FROM tl)), ts AS (SELECT template_id, count(*) AS size FROM tg GROUP BY 1),
        d AS (SELECT doc_id, n, {_LETTERS.format("text")} AS w FROM documents, (SELECT DISTINCT n FROM tl)), dg AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d)),
        h AS (SELECT doc_id, template_id, len, n, pos, g, unnest([pos // len * len, pos // len * len - len]) AS s FROM dg JOIN tg USING (n, g)),
        c AS (SELECT doc_id, template_id, s, count(DISTINCT g) AS held, min(pos) AS at_word FROM h WHERE s >= 0 AND pos + n <= s + 2 * len GROUP BY ALL),
        f AS (SELECT c.*, held::DOUBLE / size AS containment FROM c JOIN ts USING (template_id) WHERE held::DOUBLE / size >= 0.8 - 1e-9), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template_id ORDER BY containment DESC, s) AS k FROM f)
        SELECT doc_id, license, template_id, CAST(at_word AS BIGINT) AS start_word, containment FROM b JOIN t USING (template_id) WHERE k = 1""",
    # every window of the texts that hold enough of an item's weight at all
    "op9_decontamination": rf"""WITH i AS (SELECT item_id, {_LETTERS.format("text")} AS w FROM benchmark), il AS (SELECT *, len(w) AS len, least(len(w), 5) AS n FROM i WHERE len(w) > 0),
        ig AS (SELECT item_id, len, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len - n + 2)) AS k FROM il)), ic AS MATERIALIZED (SELECT item_id, len, n, g, count(*) AS c FROM ig GROUP BY ALL),
        wt AS MATERIALIZED (SELECT n, g, 1.0::DOUBLE / count(*) AS w FROM ic GROUP BY ALL), it AS (SELECT item_id, len, n, sum(c * w) AS total FROM ic JOIN wt USING (n, g) GROUP BY ALL),
        d AS (SELECT doc_id, n, {_LETTERS.format("text")} AS w FROM documents, (SELECT DISTINCT n FROM il)), dg AS MATERIALIZED (SELECT doc_id, n, len(w) AS size, k - 1 AS pos, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d)),
        r AS (SELECT h.doc_id, it.item_id, it.len, it.n, it.total FROM (SELECT DISTINCT doc_id, n, g FROM dg) h JOIN ic USING (n, g) JOIN wt USING (n, g) JOIN it USING (item_id) GROUP BY ALL HAVING sum(c * w) >= 0.8 * it.total - 1e-9),
        x AS (SELECT r.doc_id, r.item_id, r.n, r.len, r.total, g, size, unnest(range(greatest(pos - (len - r.n), 0), pos + 1)) AS s FROM r JOIN dg USING (doc_id, n)),
        v AS (SELECT doc_id, item_id, n, len, total, s, g, count(*) AS c FROM x GROUP BY ALL),
        q AS (SELECT v.doc_id, v.item_id, v.len, v.total, v.s, sum(least(v.c, coalesce(ic.c, 0)) * coalesce(w, 1)) AS held, sum(v.c * coalesce(w, 1)) AS mine FROM v LEFT JOIN wt ON wt.n = v.n AND wt.g = v.g LEFT JOIN ic ON ic.item_id = v.item_id AND ic.g = v.g GROUP BY ALL),
        f AS (SELECT *, held / (mine + total - held) AS similarity FROM q WHERE held / (mine + total - held) >= 0.8 - 1e-9), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(similarity, 9) DESC, s) AS k FROM f)
        SELECT doc_id, item_id, CAST(s AS BIGINT) AS start_word, CAST(len AS BIGINT) AS n_words, round(similarity, 6) AS similarity FROM b WHERE k = 1""",
}
