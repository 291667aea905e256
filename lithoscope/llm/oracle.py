"""SQL with the rows of those queries that SQL can express.

Tokenizers, trained models and byte strings have none; their queries are tested
against brute force, round trips or held-out rows.
"""

from __future__ import annotations

#: Words between blanks, and normalised words, as lists.
BLANK_WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, greatest(len(w)-2, least(len(w),1))+1)]) AS s FROM d),
  x AS (SELECT doc_id, unnest(s) AS g FROM s),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM c JOIN s p ON p.doc_id=a JOIN s q ON q.doc_id=b WHERE 100*n >= 90*(len(p.s)+len(q.s)-n)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, node) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node=e.a)
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(node) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents),
  x AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w)-11)) AS i, w FROM d WHERE len(w) >= 13),
  k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS g FROM x),
  h AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS low FROM k) WHERE low < doc_id),
  gone AS (SELECT DISTINCT doc_id, i+j AS i FROM h, (SELECT unnest(range(13)) AS j)),
  p AS (SELECT d.doc_id, u.i, d.w[u.i] AS t FROM d, LATERAL (SELECT unnest(range(1, len(d.w)+1)) AS i) u),
  kept AS (SELECT p.doc_id, string_agg(t, ' ' ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS text, count(gone.i) AS n_removed FROM p LEFT JOIN gone ON p.doc_id=gone.doc_id AND p.i=gone.i GROUP BY p.doc_id)
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

DECONTAMINATE = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {ITEM_WORDS} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w)-9, 1)+1)) AS i FROM b WHERE len(w) > 0)),
  d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
  dw AS (SELECT doc_id, z.size, u.i, array_to_string(d.w[u.i:u.i+z.size-1], ' ') AS g FROM d, (SELECT DISTINCT size FROM bw) z, LATERAL (SELECT unnest(range(1, len(d.w)-z.size+2)) AS i) u),
  h AS (SELECT doc_id, item, i, size FROM dw JOIN bw USING (size, g)),
  m AS (SELECT doc_id, count(DISTINCT i+j) AS n FROM (SELECT doc_id, i, unnest(range(size)) AS j FROM h) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(m.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)""".replace(' COLLATE "C"', "")

#: The characters a role's line and the marks take, and one more for each control string that had to be escaped.
CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
    UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0,1]) AS k)),
  t AS (SELECT *, role='assistant' AS learned, regexp_matches(text, '[\[<]\\+(/?INST\]|/?s>)') AS looks, replace(replace(replace(replace(role,'%','%25'),chr(10),'%0A'),'[','%5B'),'<','%3C') AS line FROM c),
  e AS (SELECT *, CASE WHEN looks OR contains(text, CASE WHEN learned THEN '</s>' ELSE '[/INST]' END) THEN len(regexp_extract_all(text, '[\[<]\\*(?:/?INST\]|/?s>)')) ELSE 0 END AS escapes FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE learned), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE learned), '')) AS loss_sha256,
    sum(length(line)+1+length(text)+escapes+CASE WHEN learned THEN 7 ELSE 13 END)::BIGINT AS formatted_chars, true AS round_trip FROM e GROUP BY conv_id"""

NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
  u AS (SELECT * FROM v WHERE len(v)=64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(v, lambda x: x<>0))>0),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id<>c.vec_id WHERE q.vec_id%20=0)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank<=20"""

#: The 256 steps of crc32 by byte as one list, and the crc32 of an ASCII text by them; ``crc_table.t`` must be in the row.
CRC_TABLE = """crc_step(i,k,c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k+1, CASE WHEN c&1=1 THEN xor(c>>1, 3988292384) ELSE c>>1 END FROM crc_step WHERE k<8),
  crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k=8)"""


def crc32(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a>>8, crc_table.t[(xor(a, b)&255)+1]), 4294967295), 4294967295)"


def _merkle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)||':'||{c} END"
    head = "||".join(f"({field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    siblings = "coalesce(string_agg(h, '') OVER (PARTITION BY g, level, i//8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY g, level, i//8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    return f"""WITH RECURSIVE {CRC_TABLE},
  d AS (SELECT doc_id, coalesce('1'||lang, '0') AS g, sha256({head}||({field("text")})) AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")}%3=0 THEN sha256({head}||({field(lower)})) END AS other FROM documents, crc_table),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)-1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
  nodes(g, level, i, n, h) AS (SELECT g, 0, i, n, leaf FROM leaves UNION ALL SELECT g, level+1, i//8, (n+7)//8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n>1 GROUP BY g, level, i//8, n),
  subroots AS (SELECT g, h, row_number() OVER (ORDER BY g)-1 AS place FROM nodes WHERE n=1),
  tops(g, level, i, n, h) AS (SELECT '', 100, place, count(*) OVER (), h FROM subroots UNION ALL SELECT g, level+1, i//8, (n+7)//8, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n>1 GROUP BY g, level, i//8, n),
  beside AS (SELECT g, level, i, {siblings} FROM nodes WHERE n>1),
  above AS (SELECT level, i, {siblings} FROM tops WHERE n>1),
  steps AS (SELECT a.g, a.i, b.level, b.l, b.r FROM leaves a JOIN beside b ON a.g=b.g AND b.i=a.i>>(3*b.level)
    UNION ALL SELECT a.g, a.i, b.level, b.l, b.r FROM leaves a JOIN subroots s ON a.g=s.g JOIN above b ON b.i=s.place>>(3*(b.level-100))),
  path AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY level) AS k FROM steps),
  folded(g, i, k, h) AS (SELECT g, i, 0, coalesce(other, leaf) FROM leaves UNION ALL SELECT f.g, f.i, f.k+1, sha256(p.l||f.h||p.r) FROM folded f JOIN path p ON p.g=f.g AND p.i=f.i AND p.k=f.k+1),
  proofs AS (SELECT g, i, string_agg(l||r, '' ORDER BY k) AS proof FROM path GROUP BY g, i),
  last AS (SELECT g, i, arg_max(h, k) AS h FROM folded GROUP BY g, i)
  SELECT a.doc_id, a.leaf, s.h AS subroot, t.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, z.h AS folded_root, z.h=t.h AS verified
  FROM leaves a JOIN subroots s USING (g) JOIN (SELECT h FROM tops WHERE n=1) t ON true JOIN last z ON z.g=a.g AND z.i=a.i LEFT JOIN proofs p ON p.g=a.g AND p.i=a.i"""


def _repair() -> str:
    """States as texts: ten digits of cost, then the letters, so that the least text is the cheapest and least repair."""
    add = lambda x, cost, letter: f"lpad((left({x}, 10)::INT+{cost})::VARCHAR, 10, '0')||substr({x}, 11)||'{letter}'"
    put = lambda x: add(x, 5, "I")
    blanks = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    kept = lambda x, initial: f"CASE WHEN initial='{initial}' THEN {add(x, 'more', 'K')} END"
    free = "least(p0, p1, p3)"
    return f"""WITH RECURSIVE {CRC_TABLE},
  c AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, {crc32("coalesce(conv_id::VARCHAR,' ')||':'||coalesce(turn::VARCHAR,' ')")}%20 AS c FROM conversations, crc_table),
  d AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, (SELECT unnest([0,1]) AS copy) WHERE c<>0 AND (copy=0 OR c=3)),
  o AS (SELECT *, left(role, 1) AS initial, right(rtrim(text, {blanks}), 1) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
  f AS (SELECT *, CASE WHEN last='' THEN 'b' WHEN seen>1 THEN 'd' WHEN last NOT IN ('.','!','?') THEN 't' ELSE '' END AS fault, initial<>'' AND lag(initial) OVER w||initial IN ('su','ua','au') AS legal, i>1 AS later FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o) WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
  s AS (SELECT conv_id, max(turn)-min(turn)+1-count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault='b') AS blank, count(*) FILTER (WHERE fault='d') AS duplicate, count(*) FILTER (WHERE fault='t') AS truncated, count(*) FILTER (WHERE later AND NOT legal) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
  z(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, 0, '0000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM s
    UNION ALL SELECT conv_id, i, {add("p0", 2, "D")}, CASE WHEN gone THEN {add("p1", 2, "D")} ELSE least({add("p1", 2, "D")}, {kept("p0", "s")}) END,
      CASE WHEN gone THEN {add("p2", 2, "D")} ELSE least({add("p2", 2, "D")}, {kept(free, "u")}, {add(free, "1+more", "R")}) END, CASE WHEN gone THEN {add("p3", 2, "D")} ELSE least({add("p3", 2, "D")}, {kept("p2", "a")}, {add("p2", "1+more", "R")}) END
    FROM (SELECT *, least(s3, {put("p2")}) AS p3 FROM (SELECT z.conv_id, f.i, s0 AS p0, s1 AS p1, least(s2, {put("s0")}, {put("s1")}, {put("s3")}) AS p2, s3, initial, fault IN ('b','d') AS gone, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i=z.i+1))),
  e AS (SELECT z.conv_id, least(s0, s3, {add(add("s1", 5, "I"), 5, "I")}, {put("s2")}) AS best FROM z JOIN s ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.i=s.n),
  a AS (SELECT conv_id, left(best, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM e),
  l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit)+1)) AS k FROM a WHERE audit<>''),
  p AS (SELECT *, count(*) FILTER (WHERE letter<>'I') OVER w AS i, count(*) FILTER (WHERE letter<>'D') OVER w AS k2 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
  t AS (SELECT p.conv_id, p.letter, p.k2, f.role, f.text, max(CASE WHEN p.k2=1 AND p.letter='K' AND f.initial='s' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s FROM p LEFT JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i=f.i WHERE p.letter<>'D'),
  g AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role||':'||text ELSE (CASE WHEN (k2-s)%2=1 THEN 'user' ELSE 'assistant' END)||':'||CASE letter WHEN 'R' THEN text ELSE '' END END, chr(10) ORDER BY k2) AS repaired FROM t GROUP BY conv_id)
  SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard": JACCARD, "op6_substring": SUBSTRING, "op7_chat_format": CHAT, "op8_decontaminate": DECONTAMINATE, "op10_nearest": NEAREST, "op12_merkle": _merkle(), "op13_repair": _repair()}
