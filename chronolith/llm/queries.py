"""The corpus operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import embed_dedup, hard_negatives, html_extract, licenses, merkle, minhash, mixing, piece_sampling, quality, quotes, repeats, token_counts, token_store
from chronolith.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, carry=["doc_id"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write(docs, token_store.tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.digest(store)


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), piece_sampling.model_path(), k=2)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", hard_negatives.shifted(), positives=5, negatives=10, low=30, high=90)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_token_store": op2_token_store,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_piece_sampling": op4_piece_sampling,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_repeats": op6_repeats,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": op9_license_scan,
    "op10_minhash": op10_minhash,
    "op11_token_counts": op11_token_counts,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _merkle_sql(levels: int = 9) -> str:
    """Trees of up to 8 ** ``levels`` leaves a language, and as many languages, level by level. A node keeps the texts of
    its siblings left and right of it; a row's path is that of its node on each level."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), CAST(4294967295 AS BIGINT))"
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS f FROM documents)",
        "p0 AS MATERIALIZED (SELECT row, lang, leaf, f, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "m0 AS MATERIALIZED (SELECT lang, i, leaf AS h FROM p0)",
        "q0 AS MATERIALIZED (SELECT row, lang, i, f, '' AS proof FROM p0)",
    ]

    def climb(m: str, q: str, grp: str) -> None:
        for k in range(levels):
            own, run = f"PARTITION BY {grp}, i // 8 ORDER BY i", f"PARTITION BY {grp}"
            parts.append(f"{m}s{k} AS MATERIALIZED (SELECT {grp}, i, h, count(*) OVER ({run}) AS n, coalesce(string_agg(h, '') OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({own} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {m}{k})")
            parts.append(f"{m}{k + 1} AS MATERIALIZED (SELECT {grp}, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {m}s{k} GROUP BY {grp}, i // 8)")
            parts.append(f"{q}{k + 1} AS MATERIALIZED (SELECT q.row, q.{grp}, q.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(s.a || q.f || s.b) ELSE q.f END AS f, q.proof || s.a || s.b AS proof FROM {q}{k} q JOIN {m}s{k} s ON s.{grp} IS NOT DISTINCT FROM q.{grp} AND s.i = q.i)")

    climb("m", "q", "lang")
    parts.append(f"o AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM m{levels})")
    parts.append("u0 AS MATERIALIZED (SELECT 1 AS one, i, subroot AS h FROM o)")
    parts.append(f"v0 AS MATERIALIZED (SELECT q.row, 1 AS one, o.i, q.f, q.proof FROM q{levels} q JOIN o ON o.lang IS NOT DISTINCT FROM q.lang)")
    climb("u", "v", "one")
    return f"WITH {', '.join(parts)} SELECT d.doc_id, d.leaf, o.subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = u.h AS verified FROM d JOIN v{levels} v USING (row) JOIN o ON o.lang IS NOT DISTINCT FROM d.lang JOIN u{levels} u ON true"


def _quality_sql(levels: int = 15) -> str:
    """Ranks of windows of 1, 2, 4 ... words by doubling; the longest repeat of a text is put together from its largest
    power down, as a text that repeats a window repeats every shorter one. Texts of up to 2 ** ``levels`` words."""
    parts = [
        r"d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        "r0 AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (ORDER BY x) AS r FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d))",
    ]
    for k in range(1, levels):
        parts.append(f"r{k} AS MATERIALIZED (SELECT a.doc_id, a.i, dense_rank() OVER (ORDER BY a.r, b.r) AS r FROM r{k - 1} a JOIN r{k - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {2 ** (k - 1)})")
    parts.append(f"s{levels} AS MATERIALIZED (SELECT doc_id, i, 0 AS n, 0 AS r FROM r0)")
    for k in range(levels - 1, -1, -1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT s.doc_id, s.i, s.n + {2 ** k} AS n, dense_rank() OVER (ORDER BY s.r, b.r) AS r FROM s{k + 1} s JOIN r{k} b ON b.doc_id = s.doc_id AND b.i = s.i + s.n)")
        parts.append(f"g{k} AS MATERIALIZED (SELECT DISTINCT doc_id FROM (SELECT doc_id, r FROM c{k} GROUP BY 1, 2 HAVING count(*) > 1))")
        parts.append(f"s{k} AS MATERIALIZED (SELECT doc_id, i, n, r FROM c{k} SEMI JOIN g{k} USING (doc_id) UNION ALL SELECT doc_id, i, n, r FROM s{k + 1} ANTI JOIN g{k} USING (doc_id))")
    parts.append("r_three AS (SELECT a.doc_id, a.i, dense_rank() OVER (ORDER BY a.r, b.r) AS r FROM r1 a JOIN r0 b ON b.doc_id = a.doc_id AND b.i = a.i + 2)")
    for name, ranks, width in (("repeated", "r_three", 3), ("covered", "r3", 8)):
        parts.append(f"{name} AS (SELECT doc_id, count(*) AS n FROM (SELECT p.doc_id, max(CASE WHEN f.c > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS hit FROM r0 p LEFT JOIN (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS c FROM {ranks}) f ON f.doc_id = p.doc_id AND f.i = p.i) WHERE hit = 1 GROUP BY 1)")
    parts += [
        "longest AS (SELECT doc_id, max(n) AS n FROM s0 GROUP BY 1)",
        r"lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1)",
        "counts AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS covered_words, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_repeat FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN longest USING (doc_id))",
        "judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)",
    ]
    return f"WITH {', '.join(parts)} SELECT *, NOT (base_failed OR 100 * covered_words > 30 * n_words OR longest_repeat > 40 AND 100 * longest_repeat > 25 * n_words) AS kept FROM judged"


ORACLES: dict[str, str] = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM w),
t AS (
  SELECT *, least(cap, coalesce((SELECT lev FROM l AS x WHERE x.lev * x.weight <= x.cap ORDER BY x.cap / x.weight, x.source LIMIT 1) * weight, cap)) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turn,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p),
r AS (
  SELECT *, epochs * size + greatest(least(CAST(floor(target) AS BIGINT) - epochs * source_size - before, size), 0) AS taken,
         before / target * CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS need FROM q)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(least(CASE turn
         WHEN 0 THEN need * 2 / (7.5::DOUBLE + sqrt(56.25::DOUBLE - need * 10))
         WHEN 1 THEN need * 2 / (1.0::DOUBLE + sqrt(1.0::DOUBLE + need * 4))
         ELSE need * 2 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + need * 2)) END, 1.0::DOUBLE), 6) END AS position
FROM r""",
    "op5_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9::DOUBLE),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op6_repeats": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INT), 100) AS s FROM (SELECT doc_id, h, unnest(range(CAST(len(h) // 2 - 49 AS BIGINT))) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS dup FROM w),
p AS (SELECT doc_id, unnest(range(CAST(len(h) // 2 AS BIGINT))) AS i FROM d),
g AS (SELECT p.doc_id, p.i, max(CASE WHEN f.dup THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone
      FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
k AS (SELECT doc_id, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM g),
a AS (SELECT k.doc_id, CAST(sum(gone::INT) AS BIGINT) AS n_removed, CAST(sum(first::INT) AS BIGINT) AS n_spans,
        string_agg(substr(d.h, CAST(2 * k.i + 1 AS INT), 2), '' ORDER BY k.i) FILTER (NOT gone) AS kept
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(a.n_removed, 0) AS n_removed, coalesce(a.n_spans, 0) AS n_spans, sha256(unhex(coalesce(a.kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
    "op7_quality_rules": _quality_sql(),
    "op10_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op12_hard_negatives": r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10""",
    "op13_merkle_manifest": _merkle_sql(),
}
