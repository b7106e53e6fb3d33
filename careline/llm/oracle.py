"""DuckDB SQL for the text queries that SQL can express.

The others learn, hash with XXH64 or compress; they are tested against brute force.
"""

from __future__ import annotations

#: One step of the checksum over a byte list: the table has the eight shifts of each byte.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256))::BIGINT AS i)))"""

SHARDING = f"""
WITH {_CRC},
nodes AS (
  SELECT shard, row_number() OVER (ORDER BY hi, shard, v) - 1 AS arc, hi,
         coalesce(lag(hi) OVER (ORDER BY hi, shard, v), max(hi) OVER ()) AS lo
  FROM (SELECT (id % 24)::INT AS shard, id // 24 AS v,
               ('0x' || substr(md5('shard/' || (id % 24) || '/' || (id // 24)), 1, 15))::BIGINT
                 AS hi
        FROM (SELECT unnest(range(0, 24 * 256)) AS id))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
         hex(encode(coalesce(text, ''))) AS digits,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos
  FROM documents),
keyed AS (
  SELECT d.doc_id, d.n + 8 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(
             range(0, d.n), lambda i:
             ('0x' || substr(d.digits, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295)
           AS text_crc32,
         coalesce(n.arc, 0) AS arc,
         (d.pos - coalesce(n.lo, l.last) + (1::BIGINT << 60)) % (1::BIGINT << 60) AS way
  FROM crc_table, sized d
  CROSS JOIN (SELECT max(hi) AS last FROM nodes) l
  LEFT JOIN nodes n ON n.lo < n.hi AND d.pos > n.lo AND d.pos <= n.hi),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arc ORDER BY way, doc_id, text_crc32, size) - 1 AS rank
  FROM keyed),
loads AS (
  SELECT n.arc, n.shard, count(k.arc) AS load
  FROM nodes n LEFT JOIN keyed k USING (arc) GROUP BY ALL),
shares AS (
  SELECT *, total // 24 + (shard < total % 24)::INT AS cap
  FROM (SELECT *, sum(load) OVER ()::BIGINT AS total,
               sum(load) OVER (PARTITION BY shard)::BIGINT AS demand,
               sum(load) OVER (PARTITION BY shard ORDER BY arc)::BIGINT AS seen,
               row_number() OVER (PARTITION BY shard ORDER BY arc) AS k
        FROM loads)),
kept AS (
  SELECT *, CASE WHEN demand > cap THEN seen * cap // demand - (seen - load) * cap // demand
                 ELSE load + k * (cap - demand) // 256 - (k - 1) * (cap - demand) // 256 END
              AS keep
  FROM shares),
sums AS (
  SELECT *, sum(greatest(load - keep, 0)) OVER (ORDER BY arc)::BIGINT AS e,
         sum(greatest(keep - load, 0)) OVER (ORDER BY arc)::BIGINT AS f
  FROM kept),
low AS (SELECT arc, e, f, (SELECT max(e) FROM sums) AS moved FROM sums ORDER BY e - f, arc LIMIT 1),
turned AS (
  SELECT s.*, s.e - low.e + CASE WHEN s.arc > low.arc THEN 0 ELSE low.moved END AS e_to,
         s.f - low.f + CASE WHEN s.arc > low.arc THEN 0 ELSE low.moved END AS f_to
  FROM sums s, low),
moves AS (
  SELECT o.arc, o.keep + greatest(o.e_to - (o.load - o.keep), i.f_to - (i.keep - i.load))
           - (o.e_to - (o.load - o.keep)) AS rank_from,
         o.keep + least(o.e_to, i.f_to) - (o.e_to - (o.load - o.keep)) AS rank_to, i.shard
  FROM turned o JOIN turned i
    ON o.load > o.keep AND i.keep > i.load
   AND o.e_to - (o.load - o.keep) < i.f_to AND i.f_to - (i.keep - i.load) < o.e_to),
pieces AS (
  SELECT *, sum(rank_to - rank_from) OVER (PARTITION BY shard ORDER BY arc, rank_from)::BIGINT
            - (rank_to - rank_from) AS base
  FROM (SELECT arc, 0 AS rank_from, least(load, keep) AS rank_to, shard FROM turned
        WHERE least(load, keep) > 0
        UNION ALL SELECT * FROM moves))
SELECT r.doc_id, r.size::BIGINT AS size, r.text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       p.shard::INT AS shard, (p.base + r.rank - p.rank_from)::BIGINT AS slot,
       NULL::INT AS grown_shard, n.shard::INT AS home_shard
FROM ranked r
JOIN pieces p ON p.arc = r.arc AND r.rank >= p.rank_from AND r.rank < p.rank_to
JOIN nodes n ON n.arc = r.arc
"""

LATTICE = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
   AND list_cosine_similarity(a.v, b.v) >= 0.98),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
least_id AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links,
       m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least_id m USING (vec_id)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')")
          + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATION = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, words[s:s + least(13, len(words)) - 1] AS part
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS s
        FROM items WHERE len(words) > 0)),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
lengths AS (SELECT DISTINCT len(part) AS n FROM windows),
places AS (
  SELECT row, s, n, words[s:s + n - 1] AS part
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS s
        FROM docs, lengths WHERE len(words) >= n)),
found AS (SELECT p.row, p.s, p.n, w.item FROM places p JOIN windows w ON p.part = w.part),
hit AS (
  SELECT row, count(DISTINCT place) AS n_hit
  FROM (SELECT row, unnest(range(s, s + n)) AS place FROM found) GROUP BY row),
named AS (
  SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
  FROM found GROUP BY row)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

WARC = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h
  FROM pages),
roles AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first_id FROM hashed)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)
                  ::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM roles
"""

#: The shares by their definition, an average over all orders.
AUDIT = r"""
WITH texts AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS s,
         coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic
             FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
split AS (
  SELECT *, list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM texts),
marked AS (
  SELECT part, good, toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 2 * length(s))::INT
         + 8 * regexp_matches(s, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY s), false)::INT AS fails
  FROM split),
cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
         list_sum(list_transform(range(1, step), lambda i:
           1 << (ascii(substr(filter_order, i::INT, 1)) - 65)))::INT AS earlier,
         1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders)),
done AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN fails & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & bit > 0 THEN n ELSE 0 END)
           AS removed,
         sum(CASE WHEN fails & coalesce(earlier, 0) > 0 AND fails & bit > 0 THEN n ELSE 0 END)
           AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & bit > 0 THEN good ELSE 0 END)
           AS good_lost,
         sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & bit > 0 THEN toxic ELSE 0 END)
           AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM done
"""

RADIX = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(s) AS text_sha256
FROM texts
"""

#: All phrases are counted; what is contained is looked for in every longer phrase.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang,
         list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces WHERE len(words) > 0),
sized AS (SELECT lang, words, i, unnest(range(1, 6)) AS k FROM places),
counted AS (
  SELECT lang, k, words[i:i + k - 1] AS phrase, count(*) AS f
  FROM sized WHERE i + k - 1 <= len(words) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= 100),
candidates AS (SELECT * FROM frequent WHERE k >= 2),
inner_parts AS (
  SELECT lang, phrase[j:j + m - 1] AS part, max(f) AS f
  FROM (SELECT lang, phrase, k, f, m, unnest(range(1, k - m + 2)) AS j
        FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k >= 3))
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c
  LEFT JOIN inner_parts i ON i.lang = c.lang AND i.part = c.phrase
  WHERE i.f IS NULL OR 100 * i.f < 100 * c.f),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r, s.n,
         (1000::HUGEINT * c.f * s.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = c.phrase[1:c.cut]
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.phrase[c.cut + 1:c.k]
  JOIN sizes s ON s.lang = c.lang),
lowest AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
named AS (SELECT *, array_to_string(phrase, ' ') AS joined FROM lowest)
SELECT lang, rank, joined AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, joined) AS rank
      FROM named)
WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lattice": LATTICE, "op3_sharding": SHARDING,
            "op4_decontamination": DECONTAMINATION, "op8_warc": WARC, "op11_audit": AUDIT,
            "op12_radix": RADIX, "op13_collocations": COLLOCATIONS}
