"""One query an operator, over the whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import Scratch
from . import contamination, langid, licenses, merkle, minhash, mixing, packing, quality, ranking, rules, tokens, toxicity, vectors

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), Scratch(spark), public_tokenizers.path(TOKENIZER))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark), public_tokenizers.path(TOKENIZER))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    out = out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return out.selectExpr("doc_id", "size", "source_size", "target", "taken", "round(position, 6) + 0.0D AS position", "round(again, 6) + 0.0D AS again")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_quality_classifier, op3_token_output, op4_best_fit_packing, op5_toxicity, op6_embedding_near_dedup,
        op7_quality_rules, op8_license_scan, op9_source_mixing, op10_language_id, op11_benchmark_decontamination, op12_merkle_manifest, op13_ranked_search, pipeline,
    )
}


def _license_sql() -> str:
    """Filters of the join are exact, so SQL needs the containment of full sets alone: of lines, and of runs of as many words as a template has."""
    phrase = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in licenses.PHRASES.items())
    template = " UNION ALL ".join(f"SELECT {k} AS id, list_distinct({t.split()!r}) AS t, {len(t.split())} AS n, '{label}' AS label" for k, (label, t) in enumerate(licenses.TEMPLATES))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda x: f"regexp_extract_all(translate({x}, '{licenses._UPPER}', '{licenses._LOWER}'), '{word}')"
    return f"""
    WITH phrases AS ({phrase}), templates AS ({template}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, {low("text")} AS w FROM d),
    places AS (
        SELECT rid, k - 1 AS pos, label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM w) x, phrases
        WHERE w[k] = p[1] AND w[k : k + len(p) - 1] = p),
    base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM places GROUP BY rid),
    lines AS (SELECT rid, list_distinct({low("line")}) AS b FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
    spots AS (
        SELECT rid, id, x.word, pos FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w) x
        JOIN (SELECT id, unnest(t) AS word FROM templates) USING (word)),
    likely AS (SELECT rid, id FROM spots JOIN templates USING (id) GROUP BY rid, id HAVING count(DISTINCT word) * 100 >= {licenses.CONTAINMENT} * any_value(len(t))),
    runs AS (
        SELECT rid, label, t, len(list_distinct(list(word) OVER (PARTITION BY rid, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND n - 1 FOLLOWING))) AS o
        FROM spots JOIN likely USING (rid, id) JOIN templates USING (id)),
    more AS (
        SELECT rid, list(DISTINCT label) AS more, max(o::DOUBLE / len(t)) AS share
        FROM (SELECT rid, label, t, len(list_intersect(b, t)) AS o FROM lines, templates WHERE len(b) > 0 UNION ALL SELECT * FROM runs)
        WHERE o * 100 >= {licenses.CONTAINMENT} * len(t) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)"""


_MIX_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
v AS (
    SELECT *, [3, 1, 2][(k % 3 + 1)::INT] AS weight, [0.5::DOUBLE, -0.5::DOUBLE, 0::DOUBLE][(k % 3 + 1)::INT] AS slope, source_size * 2 AS stop,
        (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (
    SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY stop::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY stop::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM v),
t AS (
    SELECT source, source_size, slope, least(stop::DOUBLE, coalesce(final * weight, stop::DOUBLE)) AS target
    FROM (SELECT *, max(CASE WHEN level * weight <= stop THEN level END) OVER () AS final FROM l)),
p AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
    SELECT *, greatest(least(round(target)::BIGINT - start, size), 0) AS one, greatest(least(round(target)::BIGINT - start - source_size, size), 0) AS two,
        least(start / greatest(target, 1::DOUBLE), 1::DOUBLE) AS y, least((start + source_size) / greatest(target, 1::DOUBLE), 1::DOUBLE) AS z FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
    CASE WHEN one + two > 0 THEN round(CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END, 6) + 0.0::DOUBLE END AS position,
    CASE WHEN two > 0 THEN round(CASE WHEN slope = 0 THEN z ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * z) - (1 - slope)) / (2 * slope) END, 6) + 0.0::DOUBLE END AS again
FROM q"""

def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{licenses._UPPER}', '{licenses._LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_LEAK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_words_sql("coalesce(text, '')")} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), {contamination.WINDOW}) AS n, array_to_string(w[pos : pos + {contamination.WINDOW} - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {contamination.WINDOW} + 1, 1) + 1)) AS pos FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT rid, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT rid, pos, n, item_id FROM spots JOIN win USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT rid, pos, n FROM found)) GROUP BY rid),
per AS (
    SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN per USING (rid)"""


def _merkle_sql() -> str:
    """Nodes level by level, the tops of the trees as leaves of one more; then each leaf's runs of siblings, and its claim folded along them."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join([*map(field, merkle.FIELDS[:-1]), field(text)]) + ")"
    low = f"translate(text, '{licenses._UPPER}', '{licenses._LOWER}')"
    return f"""
    WITH RECURSIVE crc(b, step, c) AS (
        SELECT b::BIGINT, 0, b::BIGINT FROM range(256) x(b)
        UNION ALL SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE step < 8),
    bytes AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE step = 8),
    d AS (
        SELECT doc_id, coalesce('.' || lang, '') AS tree, {row("text")} AS leaf, {row(low)} AS low, coalesce(doc_id::VARCHAR, '') AS id,
            list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(coalesce(doc_id::VARCHAR, ''), '') if x <> '']) AS chars FROM documents),
    l AS (
        SELECT doc_id, tree, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            CASE WHEN xor(list_reduce(chars, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 THEN low ELSE leaf END AS claim FROM d, bytes),
    nodes(tree, level, idx, h, n) AS (
        SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM l
        UNION ALL
        SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
    subroots AS (SELECT tree, h, level, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
    top(level, idx, h, n) AS (
        SELECT 0, pos, h, count(*) OVER () FROM subroots
        UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY level, idx // 8),
    runs AS (
        SELECT n.tree, n.level, n.idx // 8 AS parent, list(h ORDER BY idx) AS run FROM nodes n WHERE n > 1 GROUP BY ALL
        UNION ALL SELECT '', level - 1000, idx // 8, list(h ORDER BY idx) FROM top WHERE n > 1 GROUP BY ALL),
    walk AS (
        SELECT doc_id, tree, leaf, claim, pos, 0 AS level, pos AS idx, claim AS cur, '' AS path FROM l
        UNION ALL
        SELECT w.doc_id, w.tree, w.leaf, w.claim, w.pos, w.level + 1, w.idx // 8,
            sha256(array_to_string(run[1 : w.idx % 8], '') || cur || array_to_string(run[w.idx % 8 + 2 :], '')),
            path || array_to_string(run[1 : w.idx % 8], '') || array_to_string(run[w.idx % 8 + 2 :], '')
        FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.parent = w.idx // 8),
    mid AS (
        SELECT w.doc_id, w.tree, w.leaf, w.claim, s.pos, s.h AS subroot, w.cur, w.path FROM walk w JOIN subroots s ON s.tree = w.tree AND s.level = w.level),
    climb AS (
        SELECT doc_id, leaf, claim, subroot, -1000 AS level, pos AS idx, cur, path FROM mid
        UNION ALL
        SELECT w.doc_id, w.leaf, w.claim, w.subroot, w.level + 1, w.idx // 8,
            sha256(array_to_string(run[1 : w.idx % 8], '') || cur || array_to_string(run[w.idx % 8 + 2 :], '')),
            path || array_to_string(run[1 : w.idx % 8], '') || array_to_string(run[w.idx % 8 + 2 :], '')
        FROM climb w JOIN runs r ON r.tree = '' AND r.level = w.level AND r.level < 0 AND r.parent = w.idx // 8)
    SELECT c.doc_id, c.leaf, c.subroot, top.h AS root, sha256(c.path) AS proof_sha256, c.cur AS folded_root, c.cur = top.h AS verified
    FROM climb c JOIN top ON top.n = 1 AND top.level - 1000 = c.level"""


_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d),
i AS (SELECT row_number() OVER () AS iid, item_id, {_words_sql("text")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT iid, term, count(*)::BIGINT AS repeats FROM (SELECT iid, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (
    SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM tf, s GROUP BY term),
m AS (SELECT rid, doc_id, (25 + (75 * len(w)::BIGINT * nn) // ll)::BIGINT AS m FROM d, s),
sc AS (
    SELECT iid, rid, sum(repeats * wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM sc JOIN m USING (rid) JOIN i USING (iid) WHERE score > 0) WHERE rank <= {ranking.K}"""

ORACLE_SQL = {
    "op8_license_scan": _license_sql(), "op9_source_mixing": _MIX_SQL, "op11_benchmark_decontamination": _LEAK_SQL,
    "op12_merkle_manifest": _merkle_sql(), "op13_ranked_search": _SEARCH_SQL,
}
