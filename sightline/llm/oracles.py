"""DuckDB text for those queries of the corpus operators that SQL can express.

Learned scores, tokenizers, approximate search and packing have none; tests hold these
against brute force.
"""

from sightline.llm.licenses import FILE_SHARE, LEAST_COSINE, RUN_LENGTHS, TEMPLATES, WRAPPED_TERMS

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g
  FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
s AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM d, (SELECT DISTINCT n FROM g) z, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
m AS (SELECT doc_id, s.n, p, item_id FROM s JOIN g ON s.g = g.g AND s.n = g.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) AS t(q) GROUP BY 1),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""

OP8 = r"""
WITH l AS (SELECT doc_id, p, string_split(coalesce(text, ''), chr(10))[p] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(p)),
k AS (SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l),
i AS (SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM k WHERE t <> ''),
r AS (SELECT a.doc_id, a.n, a.t AS t1, b.t AS t2, c.t AS t3 FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN i c ON a.doc_id = c.doc_id AND c.n = a.n + 2),
f AS (SELECT *, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, n) AS o FROM r),
g AS (SELECT DISTINCT doc_id, n + j AS n FROM f, unnest([0, 1, 2]) AS t(j) WHERE o > 1),
x AS (SELECT i.doc_id, i.p FROM i JOIN g USING (doc_id, n)),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS left_text FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = l.doc_id AND x.p = l.p) GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM i WHERE i.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM x WHERE x.doc_id = d.doc_id) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(3, len(w)) - 1), ' ') AS g, least(3, len(w)) AS k FROM w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM c WHERE c.a = documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM d, unnest(range(0, len(x) // 2 - 99)) AS t(p)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS o FROM w),
r AS (SELECT doc_id, p, coalesce(p > 100 + lag(p) OVER (PARTITION BY doc_id ORDER BY p), true) AS fresh FROM f WHERE o > 1),
g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY ALL),
c AS (SELECT doc_id, k, substr(x, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS part FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM s GROUP BY 1),
h AS (SELECT doc_id, string_agg(part, '' ORDER BY k) AS kept FROM c GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN h USING (doc_id)
"""

_TERM_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]')"
_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

OP7 = f"""
WITH RECURSIVE t AS (SELECT * FROM (VALUES {_VALUES}) AS v(license, statement)),
tw AS (SELECT license, word, count(*) AS tf FROM t, unnest({_TERM_WORDS.format("statement")}) AS u(word) GROUP BY ALL),
vo AS (SELECT list(DISTINCT word) AS vocabulary FROM tw),
me AS (SELECT {RUN_LENGTHS} * max(n) AS most FROM (SELECT sum(tf) AS n FROM tw GROUP BY license)),
d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, source || '/' || lang AS dir, text FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, word FROM d, unnest({_TERM_WORDS.format("text")}) AS u(word)) WHERE word IN (SELECT word FROM tw) GROUP BY 1),
idf AS MATERIALIZED (SELECT word, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word), n),
tv AS MATERIALIZED (SELECT license, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS tw, avg(idf) OVER (PARTITION BY license) AS other FROM tw JOIN idf USING (word)),
l0 AS (SELECT doc_id, p, string_split(text, chr(10))[p] AS said FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(p)),
l1 AS (SELECT *, {_TERM_WORDS.format("said")} AS words FROM l0),
l AS MATERIALIZED (SELECT *, len(words) AS size, list_has_any(words, vocabulary) AS known, sum(len(words)) OVER o AS total, count_if(len(words) = 0) OVER o AS block FROM l1, vo WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
b AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) AS z FROM l WHERE size > 0 GROUP BY doc_id, block HAVING regexp_matches(lower(string_agg(said, chr(10) ORDER BY p)), '{WRAPPED_TERMS}')),
r AS MATERIALIZED (SELECT b.doc_id, x.p AS a, y.p AS z FROM b JOIN l x ON x.doc_id = b.doc_id AND x.p BETWEEN b.a AND b.z AND x.known JOIN l y ON y.doc_id = b.doc_id AND y.p BETWEEN x.p AND b.z AND (y.known OR y.p = b.z), me WHERE y.p = x.p OR y.total - x.total + x.size <= most
  UNION SELECT doc_id, a, z FROM b UNION SELECT doc_id, 1, max(p) FROM l WHERE doc_id IN (SELECT doc_id FROM b) GROUP BY 1),
v AS MATERIALIZED (SELECT doc_id, a, z, word, count(*) AS tf FROM (SELECT r.*, unnest(words) AS word FROM r JOIN l ON l.doc_id = r.doc_id AND l.p BETWEEN a AND z) GROUP BY ALL),
m AS (SELECT doc_id, a, z, sum(CASE WHEN idf IS NULL THEN 0 ELSE tf * idf * tf * idf END) AS own, sum(CASE WHEN idf IS NULL THEN tf * tf ELSE 0 END) AS others FROM v LEFT JOIN idf USING (word) GROUP BY ALL),
c AS (SELECT doc_id, a, z, license, round(sum(tf * idf * tw) / sqrt(any_value(own) + any_value(others) * any_value(other) * any_value(other)), 9) AS cosine FROM v JOIN idf USING (word) JOIN tv USING (word) JOIN m USING (doc_id, a, z) GROUP BY ALL),
q AS (SELECT * FROM c WHERE cosine >= {LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id, a, z ORDER BY cosine DESC, license) = 1),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license, z - a, a) AS k FROM q),
g AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS taken FROM k WHERE k = 1 UNION ALL
  SELECT g.doc_id, k.k, CASE WHEN list_has_any(taken, range(a, z + 1)) THEN taken ELSE list_concat(taken, range(a, z + 1)) END FROM g JOIN k ON k.doc_id = g.doc_id AND k.k = g.k + 1),
h AS (SELECT doc_id, arg_max(taken, k) AS taken FROM g GROUP BY 1),
f AS (SELECT doc_id FROM h JOIN l USING (doc_id) GROUP BY doc_id HAVING sum(CASE WHEN list_contains(taken, p) THEN size ELSE 0 END) >= {FILE_SHARE} * sum(size)),
o AS (SELECT doc_id, regexp_replace(license, '-short$', '') AS license, cosine FROM k WHERE k = 1),
s AS (SELECT d.dir, o.license AS dir_license FROM o JOIN f USING (doc_id) JOIN d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY d.path) = 1)
SELECT d.doc_id, d.path, coalesce(o.license, s.dir_license) AS license, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN s.dir_license IS NOT NULL THEN 'directory' ELSE 'none' END AS source,
  o.cosine, CASE WHEN o.license IS NULL AND s.dir_license IS NOT NULL THEN d.dir END AS from_dir
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN s ON s.dir = d.dir
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""

OP12 = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN g USING (doc_id)),
k AS (SELECT part, good, toxic, failed, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS early FROM o, unnest(range(1, 6)) AS t(step) WHERE length(filter_order) = 5),
x AS (SELECT *, contains(failed, f) AS fails, translate(failed, early, '') <> failed AS gone FROM k, s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(p)),
r AS (SELECT doc_id, p FROM x QUALIFY count(*) OVER (PARTITION BY s) > 1),
c AS (SELECT DISTINCT doc_id, q FROM r, unnest(range(p, p + 35)) AS t(q)),
k AS (SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS kept FROM d, unnest(range(1, len(w) + 1)) AS t(q) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.q = t.q) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES = {"op1_benchmark_decontamination": OP1, "op7_license_scan": OP7, "op8_line_dedup": OP8, "op9_jaccard_join": OP9, "op10_repeated_strings": OP10, "op11_fill_in_middle": OP11, "op12_filter_interactions": OP12, "op13_repeated_words": OP13}
