"""DuckDB SQL that gives the same rows as the queries of this subpackage, where SQL can say them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern):
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM, _NONSPACE = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), _words(r"[^\x20\x09-\x0D]+")

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_NONSPACE} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * o >= 75 * (u.n + v.n - o)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = doc_id GROUP BY doc_id"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
 h AS (SELECT DISTINCT doc_id, m, i, item FROM dw JOIN bw USING (m, g)),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
 h AS (SELECT *, len(w) AS n, ('0x' || s[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(w) + 1) AS y, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
 c AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

COLLOCATIONS = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
 f AS (SELECT lang, p, count(*) AS c FROM (SELECT lang, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)) GROUP BY 1, 2),
 n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY 1),
 c AS (SELECT lang, p, c FROM f WHERE len(p) >= 2 AND c >= 100),
 part AS (SELECT lang, c, p[i:i + m - 1] AS p FROM (SELECT lang, p, c, m, unnest(range(1, len(p) - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE len(p) > m)),
 kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = c.lang AND part.p = c.p AND 100 * part.c >= 100 * c.c)),
 cut AS (SELECT lang, p, c, unnest(range(1, len(p))) AS k FROM kept),
 s AS (SELECT cut.lang, cut.p, cut.c AS a, k, x.c AS l, y.c AS r, n, ((1000::HUGEINT * cut.c * n) // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM cut JOIN n USING (lang) JOIN f x ON x.lang = cut.lang AND x.p = cut.p[1:k] JOIN f y ON y.lang = cut.lang AND y.p = cut.p[k + 1:]),
 low AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM low
QUALIFY rank <= 2000"""
