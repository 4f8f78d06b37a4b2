"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "log_odds")


@query
def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE_SQL["op5_top_k_search"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS nr, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.nr, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.nr <> q.nr),
r AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
u AS (SELECT doc_id, n, CAST(unnest(range(0, n)) AS BIGINT) AS j FROM d),
w AS (SELECT u.doc_id, j, CASE WHEN j + 200 <= u.n THEN md5_number(array_slice(b, j + 1, j + 200)) END AS h, array_slice(b, j + 1, j + 1) AS own FROM u JOIN d USING (doc_id)),
r AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, j, own, coalesce(j - max(CASE WHEN h IN (FROM r) THEN j END) OVER (PARTITION BY doc_id ORDER BY j) < 200, FALSE) AS gone FROM w),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), FALSE) AS first FROM m),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, sha256(unhex(coalesce(string_agg(hex(own), '' ORDER BY j) FILTER (NOT gone), ''))) AS kept_sha256 FROM s GROUP BY 1)
SELECT doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
ORACLE_SQL["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, CAST(unnest(range(1, len(w) - 11)) AS BIGINT) AS i FROM d),
k AS (SELECT doc_id, i, md5_number(array_to_string(w[i : i + 12], ' ')) AS h FROM x JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM k) WHERE least < doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM r GROUP BY 1),
o AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), CAST(i AS BIGINT))), ' ') AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM o
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sunledger.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.language_id import identify, learn
    from sunledger.llm.lm_scoring import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3).alias("held_out"))
    model = learn(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i : i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 85 * (m.n + o.n - shared)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM c WHERE c.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row", "th")


@query
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_document_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(t, n - n // 2) || left(next_t, n // 2) AS edited FROM x),
a AS (SELECT doc_id, unnest([1, 2, 3]) AS which, regexp_extract_all(unnest([t, edited, next_t]), '[^\x20\x09-\x0D]+') AS w FROM e),
h AS (SELECT doc_id, which, list_transform(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 4, 1) + 1) END, lambda i: left(md5(array_to_string(w[i : i + 4], ' ')), 16)) AS h FROM a),
u AS (SELECT doc_id, which, h, list_sort(list_distinct(list_filter(h, lambda x: x < '1'))) AS u FROM h),
s AS (SELECT doc_id, which, CASE WHEN len(u) > 0 OR len(h) = 0 THEN u ELSE [list_min(h)] END AS s FROM u),
p AS (SELECT doc_id, any_value(s) FILTER (which = 1) AS s, any_value(s) FILTER (which = 2) AS s_edited, any_value(s) FILTER (which = 3) AS s_next FROM s GROUP BY 1),
c AS (SELECT *, len(list_intersect(s, s_edited)) AS both_edited, len(list_intersect(s, s_next)) AS both_next, len(list_distinct(list_concat(s, s_edited))) AS all_edited, len(list_distinct(list_concat(s, s_next))) AS all_next FROM p)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(s_edited, '') AS edited_fingerprint,
  CASE WHEN all_edited > 0 THEN both_edited / all_edited ELSE 1.0::DOUBLE END AS near_edited, CASE WHEN all_next > 0 THEN both_next / all_next ELSE 1.0::DOUBLE END AS near_next,
  CASE WHEN len(s) > 0 THEN both_edited / len(s) WHEN len(s_edited) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS contained_edited, CASE WHEN len(s) > 0 THEN both_next / len(s) WHEN len(s_next) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS contained_next, next_id
FROM e JOIN c USING (doc_id)
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.merkle import document_manifest

    return document_manifest(table(spark, sf_dir, "documents"))


def _merkle_sql() -> str:
    """Trees level by level, then each leaf's steps (siblings to the left and right of it) and what folds up from them."""
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS claimed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, dense_rank() OVER (ORDER BY g) - 1 AS gi FROM d),
a AS (SELECT gi, 0 AS level, i, n AS size, leaf AS digest FROM l UNION ALL SELECT gi, level + 1, i // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM a WHERE size > 1 GROUP BY gi, level, i // 3, size),
b AS (SELECT 0 AS level, gi AS i, (SELECT count(DISTINCT gi) FROM l) AS size, digest FROM a WHERE size = 1 UNION ALL SELECT level + 1, i // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM b WHERE size > 1 GROUP BY level, i // 3, size),
v AS (SELECT DISTINCT gi, level FROM a WHERE size > 1), z AS (SELECT DISTINCT level FROM b WHERE size > 1),
p AS (SELECT doc_id, l.gi, 0 AS tree, v.level, i // CAST(pow(3, v.level) AS BIGINT) AS i FROM l JOIN v ON v.gi = l.gi UNION ALL SELECT doc_id, 0, 1, z.level, gi // CAST(pow(3, z.level) AS BIGINT) FROM l, z),
k AS (SELECT gi, 0 AS tree, level, i, i // 3 AS up, digest FROM a UNION ALL SELECT 0, 1, level, i, i // 3, digest FROM b),
s AS (SELECT doc_id, p.tree, p.level, row_number() OVER (PARTITION BY doc_id ORDER BY p.tree, p.level) AS nr, coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (k.i < p.i), '') AS before, coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (k.i > p.i), '') AS after
  FROM p JOIN k ON k.gi = p.gi AND k.tree = p.tree AND k.level = p.level AND k.up = p.i // 3 GROUP BY 1, 2, 3),
f AS (SELECT doc_id, 0 AS nr, claimed AS digest FROM l UNION ALL SELECT f.doc_id, s.nr, sha256(s.before || f.digest || s.after) FROM f JOIN s ON s.doc_id = f.doc_id AND s.nr = f.nr + 1),
e AS (SELECT doc_id, arg_max(digest, nr) AS folded_root FROM f GROUP BY 1), h AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY nr)) AS proof_sha256 FROM s GROUP BY 1)
SELECT doc_id, leaf, a.digest AS subroot, b.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = b.digest AS verified
FROM l JOIN a ON a.gi = l.gi AND a.size = 1 JOIN b ON b.size = 1 JOIN e USING (doc_id) LEFT JOIN h USING (doc_id)
"""


ORACLE_SQL["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("scanned")


def _centroid_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """Each round in two steps: a vector's nearest centroid, and each centroid's new components."""
    out = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS nr, list_transform(embedding, lambda x: CAST(floor({size} * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, e FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h LIMIT {k})),"""
    for r in range(rounds + 1):
        out += f"""
a{r} AS (SELECT nr, arg_min(cluster, {{'d': d, 'c': cluster}}) AS cluster, min(d) AS d FROM (SELECT nr, cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY nr),"""
        if r < rounds:
            out += f"""
m{r} AS (SELECT cluster, list(m ORDER BY i) AS e FROM (SELECT cluster, i, CAST(floor(sum(x)::HUGEINT / count(*)) AS BIGINT) AS m FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, {size} + 1)) AS i FROM v JOIN a{r} USING (nr)) GROUP BY 1, 2) GROUP BY 1),
c{r + 1} AS (SELECT cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (cluster)),"""
    return f"""{out}
i AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (nr) JOIN i USING (cluster) JOIN c{rounds} c USING (cluster)
"""


ORACLE_SQL["op12_centroid_clustering"] = _centroid_sql()


# What SQL can express of op3, op4 and op9: the same operators, fewer columns.


def _rule_case(as_name: bool) -> str:
    """The first rule that fits, longest first: its name, or its action."""
    out = []
    for action, rule in sorted(URL_RULES, key=lambda x: -len(x[1])):
        at, _, start = rule.partition("/")
        out.append(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}') THEN '{rule if as_name else action}'")
    return "CASE " + " ".join(out) + " END"


@query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's columns that the rules alone decide; verdict is null where the method decides."""
    found = op3_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


ORACLE_SQL["url_rules"] = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {_rule_case(True)} AS rule, {_rule_case(False)} AS ruled FROM u
"""


@query
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's counts of base spans."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


ORACLE_SQL["pii_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(x), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE 2 * CAST(c AS INTEGER) // 10 + 2 * CAST(c AS INTEGER) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda x: len(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m
"""


@query
def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's columns of the base score."""
    return op9_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


ORACLE_SQL["lm_base"] = r"""
WITH d AS (SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, xor(crc, 4294967295) % 5 = 1 AS held_out, list_concat(w, [chr(10)]) AS w FROM d),
t AS (SELECT doc_id, held_out, unnest(w) AS word FROM h), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) AS words FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(total) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (total + 0.5 * (words + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (word), n GROUP BY 1, 2
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sunledger.llm.pipeline import run

    return run(spark, sf_dir)
