"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import exact_dedup, fm_index, heap_lloyd, language_id, line_dedup, mixing, multi_index, packing, prefix_trie, secrets, suffix_array, superminhash, winnowing
from tidecast.llm.common import read

#: Weights of the mixture; nodes that aren't named weigh 1.
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = (1, 2), 2, 17


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    put = mixing.names(docs.columns)
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)
    added = (F.col(put[name]).alias(alias) for name, alias in (("domain", "domain"), ("epoch", "epoch"), ("tokens", "n_tokens"), ("take_tokens", "take_tokens")))
    return mixed.select("doc_id", "lang", "source", *added)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digest(read(spark, sf_dir, "documents"))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.digest(read(spark, sf_dir, "documents"), size=2)


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings"))


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(read(spark, sf_dir, "conversations"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.digest(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_exact_dedup, op3_secret_scan, op4_suffix_array, op5_superminhash, op6_multi_index, op7_fm_index, op8_language_id, op9_line_dedup, op10_best_fit, op11_winnowing, op12_prefix_trie, op13_heap_lloyd)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _share(level: str, parent: str, name: str, weight: str) -> str:
    """SQL that shares each parent's budget among its children as mixing.share does."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{level}_o AS (SELECT *, {weight} AS w FROM {level}_in),
{level}_s AS (SELECT *, budget::HUGEINT - coalesce(sum(cap::HUGEINT) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
   sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww, row_number() OVER r AS rn
   FROM {level}_o WINDOW r AS ({by} ORDER BY cap::DOUBLE / w, {name})),
{level}_f AS (SELECT *, cap::HUGEINT * ww <= w::HUGEINT * l AS is_full FROM {level}_s),
{level}_a AS (SELECT *, min(CASE WHEN NOT is_full THEN rn END) OVER ({by}) AS first_open FROM {level}_f),
{level}_l AS (SELECT *, max(CASE WHEN rn = first_open THEN l END) OVER ({by}) AS ll, max(CASE WHEN rn = first_open THEN ww END) OVER ({by}) AS lw FROM {level}_a),
{level}_b AS (SELECT *, CASE WHEN NOT is_full THEN (w::HUGEINT * ll) // lw END AS base FROM {level}_l),
{level}_r AS (SELECT *, ll - sum(base) OVER ({by}) AS rest FROM {level}_b),
{level} AS (SELECT * EXCLUDE (budget, rest), CASE WHEN is_full THEN cap ELSE least(cap, base + CASE WHEN rn - first_open < rest THEN 1 ELSE 0 END) END AS budget FROM {level}_r)"""


def _weight(level: str, column: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END"


MIX_SQL = f"""
WITH docs AS (SELECT doc_id, lang AS lang_, source AS source_, coalesce(CASE WHEN right(source, 1) IN ('0','1','2','3') THEN 'web' WHEN right(source, 1) IN ('4','5','6','7') THEN 'books' ELSE 'code' END, '(none)') AS domain,
   coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n, md5(coalesce(text, '')) AS t FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {MIX_EPOCHS} AS cap FROM docs GROUP BY ALL),
d_in AS (SELECT domain, sum(cap) AS cap, (SELECT (sum(tokens) * {MIX_FRACTION[0]}) // {MIX_FRACTION[1]} FROM leaf) AS budget FROM leaf GROUP BY domain),
{_share("d", "", "domain", _weight("domain", "domain"))},
l_in AS (SELECT domain, lang, sum(leaf.cap) AS cap, any_value(d.budget) AS budget FROM leaf JOIN d USING (domain) GROUP BY ALL),
{_share("l", "domain", "lang", _weight("lang", "lang"))},
s_in AS (SELECT leaf.domain, leaf.lang, source, tokens, leaf.cap, l.budget FROM leaf JOIN l USING (domain, lang)),
{_share("s", "domain, lang", "source", "1")},
given AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS q, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM s),
keyed AS (SELECT docs.*, q, rest, md5(concat_ws('|', '{MIX_SEED}', CAST(q AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), t)) AS k FROM docs JOIN given USING (domain, lang, source)),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0) AS upto, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING) AS through FROM keyed),
cutoff AS (SELECT domain, lang, source, min(k) AS ck, min_by(rest - upto, k) AS ctake FROM run WHERE upto < rest AND through >= rest GROUP BY ALL),
taken AS (SELECT run.*, ck, ctake, q + CASE WHEN rest > 0 AND q < {MIX_EPOCHS} AND k <= coalesce(ck, 'g') THEN 1 ELSE 0 END AS copies FROM run LEFT JOIN cutoff USING (domain, lang, source)),
out AS (SELECT *, unnest(range(copies::BIGINT)) AS e FROM taken WHERE copies > 0)
SELECT doc_id, domain, lang_ AS lang, source_ AS source, e::INTEGER AS epoch, n::BIGINT AS n_tokens, CASE WHEN e = q AND k = ck THEN least(n, ctake) ELSE n END::BIGINT AS take_tokens FROM out
"""

EXACT_SQL = f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
   doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
"""

LINE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
p AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM p),
o AS (SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT doc_id, line, pos, owner IS NULL OR owner = doc_id AS stays FROM k LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


WINNOWING_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS m, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0),
bt AS (SELECT DISTINCT item_id, m, array_to_string(w[s + 1 : s + m], ' ') AS t FROM bw),
dl AS (SELECT r, w, m FROM d CROSS JOIN (SELECT DISTINCT m FROM bt) WHERE len(w) >= m),
dw AS (SELECT r, w, m, unnest(range(len(w) - m + 1)) AS s FROM dl),
hit AS (SELECT r, s, dt.m, t FROM (SELECT r, s, m, array_to_string(w[s + 1 : s + m], ' ') AS t FROM dw) dt SEMI JOIN bt USING (t)),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit JOIN bt USING (t) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


def _lloyd_round(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT r, x.p, any_value(x.x) AS x, arg_min(j, g * 16 + j) AS j, min(g) AS g FROM
   (SELECT x.r, x.p, x.x, c.j, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - c.c[i]) * (x.x[i] - c.c[i])))::HUGEINT AS g FROM x JOIN c{r} c USING (p)) x GROUP BY r, x.p),
m{r} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, j, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
   FROM (SELECT p, j, unnest(x) AS e, unnest(range(len(x))) AS i FROM a{r}) GROUP BY ALL) GROUP BY p, j),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(list_transform(m{r}.c, lambda e: e::BIGINT), c.c) AS c FROM c{r} c LEFT JOIN m{r} ON c.p = m{r}.p AND c.j = m{r}.j)"""


LLOYD_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * 4096)::BIGINT) AS v
   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM (SELECT r, v, unnest(range(8)) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, r AS j, x AS c FROM x WHERE r < 16),
{",".join(_lloyd_round(r) for r in range(heap_lloyd.ROUNDS + 1))},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS h FROM c{heap_lloyd.ROUNDS}),
e AS (SELECT r, sum(g)::BIGINT AS error, string_agg(printf('%02x', j), '' ORDER BY p) AS code FROM a{heap_lloyd.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN e USING (r) CROSS JOIN h
"""


TRIE_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
   FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) AS v FROM range(256) g(i))),
v AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, k, 1))::BIGINT)),
   lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t) CROSS JOIN crc),
o AS (SELECT v.c, i AS o, r, x FROM v JOIN t ON t.c = v.base AND i < h UNION ALL SELECT t.c, i + 5, r, x FROM t JOIN v USING (c) WHERE i >= h),
q AS (SELECT c, row_number() OVER w AS d, list({'r': r, 'x': x}) OVER w AS p, length(x) AS n FROM o WINDOW w AS (PARTITION BY c ORDER BY o)),
a AS (SELECT c, 0 AS d, [] AS p, 0 AS n FROM v UNION ALL SELECT c, d, p, n FROM q),
m AS MATERIALIZED (SELECT c, d, n, min(c) OVER (PARTITION BY d, p) AS id, d = max(d) OVER (PARTITION BY c) AS is_end FROM a),
node AS (SELECT d, id, count(*) AS k, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '') AS ends FROM m GROUP BY d, id),
up AS (SELECT node.d, node.id, m.id AS parent FROM node JOIN m ON m.c = node.id AND m.d = node.d - 1),
kids AS (SELECT d - 1 AS d, parent AS id, count(*) AS kids FROM up GROUP BY ALL),
f AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (d, id)),
s AS (SELECT m.d, m.id, sum((f.k - 1) * f.n) AS saved, count(*) FILTER (f.kids = 0) AS leaves FROM f JOIN m ON m.c = f.id AND m.d <= f.d GROUP BY ALL)
SELECT id AS conv_id, d AS depth, parent AS parent_conv_id, k AS n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN s USING (d, id) LEFT JOIN up USING (d, id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": MIX_SQL, "op2_exact_dedup": EXACT_SQL, "op9_line_dedup": LINE_SQL, "op11_winnowing": WINNOWING_SQL, "op12_prefix_trie": TRIE_SQL, "op13_heap_lloyd": LLOYD_SQL}
