"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.llm import (
    bit_slices, context_tree, conversation_repair, decontaminate, embedding_join, language, line_runs, mixing, near_duplicates,
    periodic_runs, substrings, token_files, toxicity,
)
from redressa.llm.common import shipped, table
from redressa.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(shipped(prepare(spark)), folder)

    QUERIES[query.__name__] = run
    return query


@registered
def op4_token_files(spark, folder):
    return token_files.token_output(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered
def op7_language(spark, folder):
    return language.identify(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@registered
def op10_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered
def op1_embedding_links(spark, folder):
    return embedding_join.near_vectors(table(spark, folder, "embeddings"))


ORACLES["op1_embedding_links"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS src, a AS dst FROM links
  UNION SELECT r.src, l.b FROM reach r JOIN links l ON r.dst = l.a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.root, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT src, min(dst) AS root FROM reach GROUP BY src) c ON c.src = e.vec_id
"""


@registered
def op5_near_duplicates(spark, folder):
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), words=3, share=85).drop("tag")


ORACLES["op5_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), links AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)
), reach AS (SELECT a AS src, a AS dst FROM links UNION SELECT r.src, l.b FROM reach r JOIN links l ON r.dst = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id,
  s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT src, min(dst) AS root FROM reach GROUP BY src) r ON r.src = s.doc_id
"""


@registered
def op2_substring_dedup(spark, folder):
    cut = substrings.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, t.i, md5(array_to_string(w[t.i:t.i + 34], ' ')) AS h FROM w, unnest(range(1, len(w) - 33)) t(i)
), m AS (
  SELECT DISTINCT doc_id, u.p FROM g JOIN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) USING (h), unnest(range(i, i + 35)) u(p)
), k AS (
  SELECT w.doc_id, string_agg(w.w[u.p], ' ' ORDER BY u.p) AS kept
  FROM w, unnest(range(1, len(w.w) + 1)) u(p) ANTI JOIN m ON m.doc_id = w.doc_id AND m.p = u.p GROUP BY w.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@registered
def op6_context_tree(spark, folder):
    return context_tree.language_model(table(spark, folder, "documents"))


@registered
def op3_decontaminate(spark, folder):
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[t.i:t.i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
), g AS (
  SELECT d.doc_id, t.i, s.n, array_to_string(d.w[t.i:t.i + s.n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(d.w) - s.n + 2)) t(i)
), m AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n
), h AS (SELECT doc_id, count(DISTINCT u.p) AS n FROM m, unnest(range(i, i + n)) u(p) GROUP BY doc_id
), x AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items,
  sha256(coalesce(x.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""


MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"domain0": 3, "domain1": 2, "domain2": 4}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 2}, "source": {"src0": 2, "src1": 0.5}}


@registered
def op8_source_mix(spark, folder):
    docs = mixing.described(table(spark, folder, "documents"))
    return mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, share=0.9, epochs=2, seed=11).drop("tag")


def _mix_level(parent: str, name: str, weight: str, above: str, out: str) -> str:
    """One level of the tree, as a chain of common table expressions."""
    on = f"USING ({parent})"
    part = f"PARTITION BY {parent}"
    keys = f"{parent}, {name}"
    return f"""
{out}0 AS (SELECT {keys}, sum(tokens) * 2.0::DOUBLE AS c, any_value({weight}) AS w FROM leaf GROUP BY {keys}),
{out}1 AS (SELECT *, c / w AS r FROM {out}0 JOIN {above} {on}),
{out}2 AS (SELECT *, coalesce(sum(c) OVER ({part} ORDER BY r, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + r * sum(w) OVER ({part} ORDER BY r, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b + 1e-6 AS sat FROM {out}1),
{out} AS (SELECT {keys}, CASE WHEN sat THEN c ELSE greatest(0, b - coalesce(sum(CASE WHEN sat THEN c END) OVER ({part}), 0))
  / sum(CASE WHEN sat THEN 0 ELSE w END) OVER ({part}) * w END AS b FROM {out}2)"""


ORACLES["op8_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, text, 'domain' || coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 3, 0) AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 0 AS root,
    CASE domain WHEN 'domain0' THEN 3 WHEN 'domain1' THEN 2 WHEN 'domain2' THEN 4 ELSE 1 END::DOUBLE AS wd,
    CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END::DOUBLE AS wl,
    CASE source WHEN 'src0' THEN 2 WHEN 'src1' THEN 0.5 ELSE 1 END::DOUBLE AS ws
  FROM d GROUP BY domain, lang, source
), top AS (SELECT root, sum(tokens) * 0.9::DOUBLE AS b FROM leaf GROUP BY root),""" + ",".join([
    _mix_level("root", "domain", "wd", "top", "x"), _mix_level("root, domain", "lang", "wl", "x", "y"),
    _mix_level("root, domain, lang", "source", "ws", "y", "z"),
]) + r""", plan AS (
  SELECT domain, lang, source, tokens, floor(round(b, 3))::BIGINT AS budget,
    CASE WHEN tokens > 0 THEN least(2, floor(floor(round(b, 3)) / tokens)) ELSE 0 END::BIGINT AS whole
  FROM z JOIN leaf USING (domain, lang, source)
), o AS (
  SELECT doc_id, domain, lang, source, n_tokens, budget, whole, budget - whole * tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11:' || whole || ':' || doc_id), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, budget, whole + CASE WHEN upto <= rest AND whole < 2 THEN 1 ELSE 0 END AS copies FROM o
"""


@registered
def op9_line_runs(spark, folder):
    cut = line_runs.remove_runs(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op9_line_runs"] = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS w FROM documents
), q AS (SELECT doc_id, u.i, w[u.i] AS line, rtrim(w[u.i], ' ') AS x FROM l, unnest(range(1, len(w) + 1)) u(i)
), p AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM q WHERE x <> ''
), r AS (
  SELECT doc_id, s, 1 AS n, md5(x) AS h FROM p QUALIFY count(*) OVER (PARTITION BY md5(x)) > 1
  UNION ALL
  SELECT r.doc_id, r.s, r.n + 1, md5(r.h || p.x) FROM r JOIN p ON p.doc_id = r.doc_id AND p.s = r.s + r.n
  QUALIFY count(*) OVER (PARTITION BY md5(r.h || p.x)) > 1
), later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS gone FROM p
), fate AS (
  SELECT q.doc_id, q.line, q.i, coalesce(last_value(later.gone IGNORE NULLS) OVER (PARTITION BY q.doc_id ORDER BY q.i ROWS UNBOUNDED PRECEDING), false) AS gone
  FROM q LEFT JOIN later USING (doc_id, i)
), g AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS t FROM fate GROUP BY doc_id)
SELECT l.doc_id, len(l.w)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(m.n, 0)::BIGINT AS longest_run,
  sha256(coalesce(g.t, '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, max(n) AS n FROM r GROUP BY doc_id) m USING (doc_id)
"""


@registered
def op11_bit_sliced_topk(spark, folder):
    return bit_slices.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op11_bit_sliced_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id)::INTEGER AS rank,
  v.vec_id AS vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""


@registered
def op12_periodic_runs(spark, folder):
    runs = periodic_runs.periodic_runs(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")))
    return runs.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(periodic_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc32(text: str) -> str:
    """CRC-32 of a text of plain characters, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295)"


ORACLES["op12_periodic_runs"] = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o,
    {_crc32("doc_id::VARCHAR")} AS h FROM documents
), c AS (SELECT doc_id, o, len(o) AS n, h, (h // 10) % greatest(len(o), 1) AS a, h // 10 AS g FROM d
), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM c
), t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM p
), w AS (SELECT doc_id, n, i, w[i + 1] AS w FROM t, unnest(range(0, n)) u(i)
), e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e
), r AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY ALL
), l AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS best FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, u.i FROM runs, unnest(range(start + period, start + length)) u(i)
), kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@registered
def op13_conversation_repair(spark, folder):
    rows = conversation_repair.damaged(table(spark, folder, "conversations"))
    return conversation_repair.repair_conversations(rows)


def _edited(source: str, cost: str, letter: str) -> str:
    """A prefix, as nine digits of cost and its audit, after one more edit."""
    return f"(lpad(((substr({source}, 1, 9))::BIGINT + {cost})::VARCHAR, 9, '0') || substr({source}, 10) || '{letter}')"


def _cheapest(*prefixes: str) -> str:
    """Text order is cost, then audit; nulls are states that cannot be reached."""
    return f"least({', '.join(prefixes)})"


ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations
), y AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM x WHERE k <> 0
), r AS (
  SELECT *, row_number() OVER c AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS e, left(role, 1) AS f, lag(left(role, 1)) OVER c AS before
  FROM y WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), n AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r
), g AS (
  SELECT conv_id, i, f, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM n
), step AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, i, {_edited("s0", "2", "D")},
    {_cheapest(_edited("s1", "2", "D"), "CASE WHEN NOT must AND f = 's' THEN " + _edited("s0", "cut", "K") + " END")},
    {_cheapest(_edited("t2", "2", "D"), "CASE WHEN NOT must AND f = 'u' THEN " + _edited("tu", "cut", "K") + " END", "CASE WHEN NOT must THEN " + _edited("tu", "cut + 1", "R") + " END")},
    {_cheapest(_edited("t3", "2", "D"), "CASE WHEN NOT must AND f = 'a' THEN " + _edited("t2", "cut", "K") + " END", "CASE WHEN NOT must THEN " + _edited("t2", "cut + 1", "R") + " END")}
  FROM (
    SELECT g.conv_id, g.i, g.f, g.must, g.cut, s0, s1, t2, least(s3, {_edited("t2", "5", "I")}) AS t3, least(s0, s1, s3, {_edited("t2", "5", "I")}) AS tu
    FROM (SELECT *, least(s2, {_edited("s0", "5", "I")}, {_edited("s1", "5", "I")}, {_edited("s3", "5", "I")}) AS t2 FROM step) s
    JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1
  )
), fin AS (
  SELECT conv_id, least(s0, s3, {_edited("s2", "5", "I")}, {_edited(_edited("s1", "5", "I"), "5", "I")}) AS z FROM step
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), edits AS (
  SELECT conv_id, p, substr(z, 9 + p, 1) AS c FROM fin, unnest(range(1, length(z) - 8)) u(p)
), walk AS (
  SELECT *, sum(CASE WHEN c = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN c = 'D' THEN 0 ELSE 1 END) OVER w AS turn_no
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), out AS (
  SELECT w.conv_id, w.p, w.c, w.turn_no, CASE WHEN w.c = 'I' THEN NULL ELSE n.role END AS role, CASE WHEN w.c = 'I' THEN '' ELSE n.text END AS text,
    max(CASE WHEN w.c = 'K' AND n.f = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS opened
  FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = greatest(w.i, 1) WHERE w.c <> 'D'
), fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (turn_no - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS h
  FROM out GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || f NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(z, 1, 9)::BIGINT, 0) AS cost,
  coalesce(substr(z, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM o.conv_id
"""
