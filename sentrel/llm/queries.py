"""The registered queries of this package and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sentrel.llm import automaton_dedup, decontaminate, importance, jaccard_join, language_id, licenses, lm_score, mixing, point_in_time, quality_rules, quotation, repair, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet"))


def op2_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score_texts(_documents(spark, d).select("doc_id", "text"))


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(_documents(spark, d).select("doc_id", "text", "lang"))


def op5_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return importance.resample(_documents(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))


def op4_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken")


def op7_quotation_linking(spark: SparkSession, d: str) -> DataFrame:
    return quotation.link_quotes(spark.read.parquet(f"{d}/conversations.parquet"))


def quoted_replies(spark: SparkSession, d: str) -> DataFrame:
    """The quotation operator where messages quote: each begins with the first and the
    last line of the message before it, as two passages."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    before = F.split(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text")), "\n")
    quoted = F.concat(F.lit("> "), F.get(before, F.lit(0)), F.lit("\n\n> > "), F.element_at(before, -1), F.lit("\n"))
    said = c.withColumn("text", F.concat(F.coalesce(quoted, F.lit("")), F.coalesce("text", F.lit(""))))
    return quotation.link_quotes(said).select("conv_id", "turn", "max_level", "n_quotes", "n_linked", "reply_conv", "reply_to", "anchor", "position", F.md5("own_text").alias("own_md5"))


def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    out = quality_rules.apply_rules(_documents(spark, d).select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(_documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.similar_groups(_documents(spark, d).select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = automaton_dedup.dedup_passages(_documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, d).select("doc_id", "text"))


def op12_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    return point_in_time.features(*(spark.read.parquet(f"{d}/{t}.parquet") for t in ("sales", "sale_lines", "clicks")))


def op13_repair(spark: SparkSession, d: str) -> DataFrame:
    return repair.audit(spark.read.parquet(f"{d}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_language_id, op4_mix_sources, op5_importance_resampling, op6_suffix_dedup, op7_quotation_linking, op8_jaccard_join, op9_substring_dedup, op10_quality_rules, op11_license_scan, op12_point_in_time, op13_repair, quoted_replies)}

#: CRC-32 in SQL: the table of the reflected polynomial, and the sum of an ASCII text.
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT)) ORDER BY n) AS crc_of FROM range(256) r(n))"


def crc32_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc_of[CAST(1 + (xor(c, b) & 255) AS INT)]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _cents(x: str) -> str:
    return f"coalesce(CAST(floor(100 * {x} + 0.5::DOUBLE) AS BIGINT), 0)"


POINT_IN_TIME = f"""
WITH s AS (SELECT sale_id, client_id, sold_at, arrived_at + INTERVAL 240 MINUTE AS seen, {_cents("total")} AS cents, sold_at + to_seconds(CAST({crc32_sql("CAST(sale_id AS VARCHAR)")} % 259200 AS BIGINT)) AS t
    FROM sales, {CRC_TABLE} AS crc WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
c AS (SELECT client_id, ts, click_id, kind, arrived_at + INTERVAL 240 MINUTE AS seen, {_cents("value")} AS cents FROM (SELECT DISTINCT * FROM clicks)),
p AS (SELECT sale_id, client_id, t, d, t - to_days(d) AS since FROM s, (SELECT unnest([2, 14])::INT AS d)),
pc AS (SELECT p.sale_id, p.d, count(*) AS n_clicks, count(*) FILTER (c.kind = 'purchase') AS n_purchases, CAST(sum(c.cents) AS BIGINT) AS click_cents,
    arg_max(c.click_id, (c.ts, c.click_id)) AS last_click_id FROM p JOIN c ON c.client_id = p.client_id AND c.ts > p.since AND c.ts <= p.t AND c.seen <= p.t GROUP BY ALL),
ps AS (SELECT p.sale_id, p.d, p.t, s.sale_id AS other, s.cents FROM p JOIN s ON s.client_id = p.client_id AND s.sold_at > p.since AND s.sold_at <= p.t AND s.seen <= p.t),
pn AS (SELECT sale_id, d, count(*) AS n_sales, CAST(sum(cents) AS BIGINT) AS sale_cents FROM ps GROUP BY ALL),
pl AS (SELECT ps.sale_id, ps.d, count(*) AS n_lines, count(DISTINCT l.item_id) AS n_items, CAST(sum({_cents("l.amount")}) AS BIGINT) AS line_cents FROM ps JOIN sale_lines l ON l.sale_id = ps.other AND l.shipped_at <= ps.t GROUP BY ALL),
later AS (SELECT DISTINCT a.sale_id FROM s a JOIN s b ON b.client_id = a.client_id AND b.sold_at > a.t AND b.sold_at <= a.t + INTERVAL 7 DAY)
SELECT p.sale_id, p.d, epoch_us(p.t) AS t_us, later.sale_id IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0) AS click_cents, last_click_id,
    coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0) AS line_cents
FROM p LEFT JOIN pc USING (sale_id, d) LEFT JOIN pn USING (sale_id, d) LEFT JOIN pl USING (sale_id, d) LEFT JOIN later USING (sale_id)"""

#: Shortest edits row by row: of every state the cheapest audit, then the least one.
REPAIR = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, {CRC_TABLE} AS crc),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS c FROM d WHERE k <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) > 1 AS again, regexp_replace(text, '[ 	-
]+$', '') AS kept FROM r),
g AS (SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM o),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
ins(q, q2, c, e, w) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)),
    (2, 3, 2, 'I', 'assistant:' || chr(10)), (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
act(q, e, ini, q2, c) AS (VALUES (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
    (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (3, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''}} AS best FROM stats
    UNION ALL
    SELECT conv_id, i, q, min(best) AS best FROM (
        SELECT dp.conv_id, g.i AS i, act.q2 AS q, {{'cost': dp.best.cost + ins.c + act.c + CASE WHEN act.e <> 'D' AND g.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': dp.best.audit || ins.e || act.e,
            'body': dp.best.body || ins.w || CASE act.e WHEN 'D' THEN '' WHEN 'K' THEN g.role || ':' || g.text || chr(10) ELSE CASE act.q2 WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || g.text || chr(10) END}} AS best
        FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1 JOIN ins ON ins.q = dp.q JOIN act ON act.q = ins.q2
        WHERE (act.e = 'D' OR g.fault NOT IN ('blank', 'duplicate')) AND (act.e <> 'K' OR act.ini = g.ini)) GROUP BY conv_id, i, q),
done AS (SELECT dp.conv_id, min({{'cost': best.cost + ins.c, 'audit': best.audit || ins.e, 'body': best.body || ins.w}}) AS best FROM dp JOIN stats s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = s.n JOIN ins ON ins.q = dp.q WHERE ins.q2 IN (0, 3) GROUP BY dp.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.body, length(best.body) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES: dict[str, str] = {
    "op11_license_scan": licenses.sql(),
    "op13_repair": REPAIR,
    "op12_point_in_time": POINT_IN_TIME,
    "op4_mix_sources": r"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', '13', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(text, ''))) AS h FROM documents),
s AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w, 2.0::DOUBLE * source_size AS cap FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM r GROUP BY source)),
v AS (SELECT *, row_number() OVER o AS k, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS l FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, n_docs, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM v, (SELECT min_by(l, k) AS level FROM v WHERE cap > l * w)),
q AS (SELECT source, count(*) AS seats FROM (SELECT source, target / (2 * k + 1) AS x, k FROM (SELECT source, target, unnest(range(CAST(floor((SELECT sum(target) FROM t) / 256) AS BIGINT))) AS k FROM t WHERE target > 0)
  QUALIFY row_number() OVER (ORDER BY x DESC, source NULLS LAST, k) <= (SELECT floor(sum(target) / 256) FROM t)) GROUP BY source),
d AS (SELECT r.source, h, any_value(size) * count(*) AS long, count(*) AS same, any_value(CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(n_docs / 4000.0) AS BIGINT)) AS shard FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source GROUP BY r.source, h),
c AS (SELECT d.source, shard, CAST(sum(long) AS BIGINT) AS line, any_value(coalesce(q.seats, 0)) AS seats FROM d LEFT JOIN q ON q.source IS NOT DISTINCT FROM d.source GROUP BY d.source, shard),
p AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, seats, line / (2 * k + 1) AS x, k FROM (SELECT *, unnest(range(seats)) AS k FROM c WHERE line > 0)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY x DESC, shard, k) <= seats) GROUP BY source, shard),
w AS (SELECT c.source, c.shard, line, least(coalesce(quota, 0) * 256, 2 * line) AS words,
  CASE WHEN line > 0 THEN CAST('0x' || substr(md5(concat_ws('|', '13', coalesce(c.source, '~'), CAST(c.shard AS VARCHAR))), 1, 8) AS BIGINT) % CAST(ceil(line / 256.0) AS BIGINT) * 256 ELSE 0 END AS o FROM c LEFT JOIN p ON p.source IS NOT DISTINCT FROM c.source AND p.shard = c.shard),
x AS (SELECT d.*, line, CASE WHEN line > 0 THEN words // line ELSE 0 END AS rounds, CASE WHEN line > 0 THEN words % line ELSE 0 END AS part, o, CAST(sum(long) OVER (PARTITION BY d.source, d.shard ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) - long AS a FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source AND w.shard = d.shard),
y AS (SELECT source, h, (rounds * long + greatest(0, least(a + long, least(o + part, line)) - greatest(a, o)) + greatest(0, least(a + long, o + part - line) - greatest(a, 0))) // same AS taken FROM x)
SELECT r.doc_id, r.size, t.source_size, t.target, CAST(y.taken AS BIGINT) AS taken FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source JOIN y ON y.source IS NOT DISTINCT FROM r.source AND y.h = r.h""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n, o, substr(h, 2 * o + 1, 1200) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT), 400)) AS o FROM d)),
b AS (SELECT doc_id, n, o, g, unnest(range(least(400, n - o))) AS q FROM e),
s AS (SELECT doc_id, o + q AS p, n, substr(g, 2 * q + 1, 2) AS x, CASE WHEN o + q + 200 <= n THEN hash(substr(g, 2 * q + 1, 400), 7) END AS k FROM b),
t AS (SELECT k FROM s WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
m AS (SELECT s.doc_id, p, x, max(CASE WHEN t.k IS NOT NULL THEN p END) OVER (PARTITION BY s.doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM s LEFT JOIN t ON s.k = t.k),
c AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM m),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op7_quotation_linking": r"""
WITH l AS (SELECT conv_id, turn, role, k, s, length(regexp_replace(pre, '[^>]', '', 'g')) AS level, substr(s, length(pre) + 1) AS content FROM (
  SELECT *, regexp_extract(s, '^((?:[ \t]*>)+)[ \t]?') AS pre FROM (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS s, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM conversations))),
m AS (SELECT conv_id, turn, role, coalesce(string_agg(content, chr(10) ORDER BY k) FILTER (level = 0), '') AS own_text, max(level) AS max_level FROM l GROUP BY ALL),
p AS (SELECT conv_id, turn, level, string_agg(content, chr(10) ORDER BY k) AS p FROM (SELECT *, k - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY k) AS run FROM l WHERE level > 0) GROUP BY conv_id, turn, level, run),
q AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM p WHERE h <> ''),
t AS (SELECT DISTINCT conv_id AS oc, turn AS ot, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM (SELECT conv_id, turn, unnest(list_append(string_split(own_text, chr(10)), own_text)) AS x FROM m) WHERE h <> ''),
f AS (SELECT h, min((oc, ot)) AS o FROM t GROUP BY h),
n AS (SELECT q.conv_id, q.turn, q.level, q.h, max(ot) AS near FROM q LEFT JOIN t ON t.h = q.h AND t.oc = q.conv_id AND t.ot < q.turn GROUP BY ALL),
k AS (SELECT conv_id, turn, count(*) AS nq, count(*) FILTER (near IS NOT NULL OR far IS NOT NULL) AS nl, max(near) AS near, min(far) AS far FROM (
  SELECT n.*, CASE WHEN near IS NULL AND (o[1] <> conv_id OR o[2] < turn) THEN o END AS far FROM n LEFT JOIN f USING (h)) GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, own_text, CAST(max_level AS INT) AS max_level, coalesce(nq, 0) AS n_quotes, coalesce(nl, 0) AS n_linked,
  CASE WHEN near IS NULL AND far IS NOT NULL THEN far[1] WHEN near IS NOT NULL OR e.turn IS NOT NULL THEN m.conv_id END AS reply_conv,
  CAST(CASE WHEN near IS NULL AND far IS NOT NULL THEN far[2] WHEN near IS NOT NULL THEN near WHEN e.turn IS NOT NULL THEN m.turn - 1 END AS BIGINT) AS reply_to,
  CAST(coalesce(near, m.turn) AS BIGINT) AS anchor,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(near, m.turn), m.turn, md5(coalesce(m.role, '~') || '|' || own_text)) AS position
FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) e ON e.conv_id = m.conv_id AND e.turn = m.turn - 1""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
c AS (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN c USING (doc_id, s)) GROUP BY doc_id),
l AS (SELECT doc_id, k, s, w, len(w) AS n, row_number() OVER (PARTITION BY doc_id, s ORDER BY k) > 1 AS dup FROM (
  SELECT doc_id, s, k, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS k FROM d)) WHERE len(w) > 0),
j AS (SELECT *, 4 * len(list_filter(w, lambda x: x IN ('|', '>', '»', '•'))) >= n
    OR 10 * (strlen(s) - strlen(regexp_replace(s, '[#*$%&|<>]', '', 'g'))) > strlen(s)
    OR (length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 20 AND length(regexp_replace(s, '[^A-Z]', '', 'g')) > length(regexp_replace(s, '[^a-z]', '', 'g')))
    OR (n >= 12 AND NOT regexp_matches(s, '[.!?:;,…]')) OR (n >= 10 AND 3 * len(list_distinct(w)) < n) AS junk,
  n < 40 AND regexp_matches(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^0-9a-z\x{80}-\x{10FFFF}])(all rights reserved|released under the|licensed under|terms of service|privacy policy|cookie policy|click here|sign up|subscribe to|share this|alle rechte vorbehalten|allgemeine geschäftsbedingungen|datenschutzerklärung|hier klicken|jetzt anmelden|newsletter abonnieren|lizenziert unter|tous droits réservés|conditions générales|politique de confidentialité|cliquez ici|inscrivez-vous|abonnez-vous|sous licence|todos los derechos reservados|términos y condiciones|política de privacidad|haga clic aquí|regístrese|suscríbase|bajo licencia)($|[^0-9a-z\x{80}-\x{10FFFF}])') AS boiler FROM l),
a AS (SELECT doc_id, count(*) FILTER (dup) AS dups, coalesce(sum(n) FILTER (dup OR junk OR boiler), 0) AS lost, coalesce(sum(n) FILTER (NOT dup AND NOT junk AND NOT boiler), 0) AS kept FROM j GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(kept, 0) AS kw FROM d LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kw > 0 AND 100 * lost <= 50 * n_words AS kept FROM b""",
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS l FROM d), unnest(l) AS u(sh)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (s) WHERE doc_id > first),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
}

QUOTING = """(SELECT conv_id, turn, role, coalesce('> ' || lines[1] || chr(10) || chr(10) || '> > ' || lines[-1] || chr(10), '') || coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), chr(10)) AS lines FROM main.conversations))"""
ORACLES["quoted_replies"] = f"SELECT conv_id, turn, max_level, n_quotes, n_linked, reply_conv, reply_to, anchor, position, md5(own_text) AS own_md5 FROM (WITH conversations AS {QUOTING}, " + ORACLES["op7_quotation_linking"].strip().removeprefix("WITH ") + ")"
