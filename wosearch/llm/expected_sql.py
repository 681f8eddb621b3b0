"""Equivalent DuckDB statements of the queries that SQL can express."""

from wosearch.llm.lattice import THRESHOLD
from wosearch.llm.mixing import BLOCK, GOLDEN, LIMIT, SEED, SHARE, UNIT, WEIGHTS
from wosearch.llm.warc import ALPHABET, LEAST_BYTES

_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}][(rank - 1) % {len(WEIGHTS)} + 1] AS weight,
         source_size * {LIMIT}::DOUBLE AS most FROM named),
levelled AS (
  SELECT *, most / weight AS level, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget,
         coalesce(sum(most) OVER (ORDER BY most / weight, rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS settled,
         sum(weight) OVER (ORDER BY most / weight, rank
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed),
judged AS (SELECT *, settled + level * open_weight <= budget AS is_full FROM levelled),
targets AS (
  SELECT rank, source, source_size, CASE WHEN is_full THEN most ELSE
    (budget - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) * weight
    / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM judged),
sources AS (SELECT *, CAST(round(target) AS BIGINT) AS words FROM targets),
intervals AS (
  SELECT rank, words,
         floor((sum(words) OVER (ORDER BY rank) - words) * ({UNIT}::DOUBLE / total)) AS low,
         floor(sum(words) OVER (ORDER BY rank) * ({UNIT}::DOUBLE / total)) AS high
  FROM sources, (SELECT greatest(sum(words), 1)::DOUBLE AS total FROM sources)),
slots AS (
  SELECT rank, words, slot, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS block
  FROM (SELECT range AS slot, (range % {UNIT} * {GOLDEN}) % {UNIT} AS point
        FROM range(CAST((SELECT ceil(sum(words) / {BLOCK}) FROM sources) AS BIGINT)))
  JOIN intervals ON point >= low AND point < high),
placed AS (
  SELECT d.*, s.rank, s.source_size, s.target, s.words,
         sum(size) OVER (PARTITION BY s.rank ORDER BY place, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start,
         row_number() OVER () AS n
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
readings AS (
  SELECT *, reading * source_size + start AS low,
         least(reading * source_size + start + size, words) AS high
  FROM placed, (SELECT unnest([0, 1]) AS reading)),
taken AS (
  SELECT n, CAST(sum(high - low) AS BIGINT) AS taken FROM readings WHERE low < high GROUP BY n),
firsts AS (
  SELECT n, min(slot) AS first_slot FROM readings r JOIN slots s
    ON s.rank = r.rank AND s.block BETWEEN r.low // {BLOCK} AND (r.high - 1) // {BLOCK}
  WHERE low < high AND s.block * {BLOCK} < s.words GROUP BY n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot
FROM placed LEFT JOIN taken USING (n) LEFT JOIN firsts USING (n)"""

# Every pair of a label; the query finds its pairs by lattice cells.
_LATTICE = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v))
        / sqrt(list_dot_product(b.v, b.v)) >= {THRESHOLD}::DOUBLE),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
rooted AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM rooted"""

# Two children a node, as in the query.
_MERKLE = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS codes
  FROM documents),
checked AS (
  SELECT *, xor(list_reduce(codes, lambda c, b: list_reduce(range(8),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END,
    xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM fields),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN
           sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS replaced
  FROM checked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
trees AS (
  SELECT lang, 0 AS level, idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM trees WHERE n > 1 GROUP BY lang, level, idx // 2, n),
subroots AS (
  SELECT lang, level AS height, h AS subroot,
         row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM trees WHERE n = 1),
forest AS (
  SELECT 0 AS level, idx, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM forest WHERE n > 1 GROUP BY level, idx // 2, n),
steps AS (
  SELECT p.lang, p.idx, t.level, p.idx >> t.level & 1 AS slot, s.h AS sibling
  FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang AND t.idx = p.idx >> t.level AND t.n > 1
  LEFT JOIN trees s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = t.level AND s.idx = xor(p.idx >> t.level, 1)
  UNION ALL
  SELECT p.lang, p.idx, g.height + t.level, g.idx >> t.level & 1, s.h
  FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang
  JOIN forest t ON t.idx = g.idx >> t.level AND t.n > 1
  LEFT JOIN forest s ON s.level = t.level AND s.idx = xor(g.idx >> t.level, 1)),
ways AS (
  SELECT lang, idx, string_agg(sibling, '' ORDER BY level) AS siblings,
         list({'slot': slot, 'h': coalesce(sibling, '')} ORDER BY level) AS way
  FROM steps GROUP BY lang, idx),
folds AS (
  SELECT p.doc_id, p.leaf, p.lang, coalesce(siblings, '') AS siblings, coalesce(way, []) AS way, 1 AS step,
         coalesce(replaced, leaf) AS h
  FROM placed p LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.idx = p.idx
  UNION ALL
  SELECT doc_id, leaf, lang, siblings, way, step + 1,
         sha256(CASE WHEN way[step].slot = 1 THEN way[step].h || h ELSE h || way[step].h END)
  FROM folds WHERE step <= len(way))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, f.h AS folded_root,
       f.h = root AS verified
FROM folds f JOIN subroots g ON g.lang IS NOT DISTINCT FROM f.lang
CROSS JOIN (SELECT h AS root FROM forest WHERE n = 1) WHERE step > len(way)"""

_WARC = f"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
numbered AS (
  SELECT *, strlen(payload) AS payload_bytes,
         row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS response
  FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         '{ALPHABET}'[1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
                            >> (15 - 5 * (i % 4))) & 31)]), 'string_agg', '') AS payload_digest,
       CASE WHEN place > 1 AND payload_bytes >= {LEAST_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN place > 1 AND payload_bytes >= {LEAST_BYTES} THEN response END AS refers_to
FROM numbered"""

LLM_SQL: dict[str, str] = {
    "op3_mixing": _MIXING, "op7_lattice": _LATTICE, "op11_merkle": _MERKLE, "op13_warc": _WARC,
}
