"""DuckDB SQL of the training-data queries that SQL can express.

Sharding: the lookup table is filled here on its own, by one pass over all (turn, shard) offers: in a turn every
shard offers the slots of its order one after the other and takes the first that nobody holds.
Decontamination: every window of ten item words (or a whole shorter item) is looked for at every place of every document.
Spelling variants: words meet by what is left when one letter goes. Exact duplicates: whole normalised texts are compared.
Conversations: a table of least costs and audits, row by row, for all conversations at once.
The other operators need tokenizers, trained models, connected components or 64-bit hashes of Spark; they
are tested against brute force.
"""

from __future__ import annotations

import hashlib

from stackwise.llm import sharding


def _sharding() -> str:
    size, names = sharding.SIZE, sharding.SHARDS
    digits = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)  # noqa: E731
    orders = [iter([(digits(n + "#offset") + j * (digits(n + "#skip") % (size - 1) + 1)) % size for j in range(size)]) for n in names]
    owner: dict[int, str] = {}
    turn = 0
    while len(owner) < size:
        name = names[turn % len(names)]
        owner[next(s for s in orders[turn % len(names)] if s not in owner)] = name
        turn += 1
    rows = ", ".join(f"({slot}, '{name}')" for slot, name in sorted(owner.items()))
    slot = f"CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {size}"
    return f"SELECT t.slot, d.doc_id, t.shard FROM (SELECT doc_id, {slot} AS slot FROM documents) d JOIN (VALUES {rows}) AS t(slot, shard) ON d.slot = t.slot"


def _decontamination() -> str:
    words = r"regexp_extract_all(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"
    return f"""
WITH item AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item_id, {words.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS g
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM item WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT DISTINCT n FROM win),
doc AS MATERIALIZED (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {words.format('text')} END AS w FROM documents),
place AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM doc, size WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT p.doc_id, p.n, p.k, w.item_id FROM place p JOIN win w ON p.n = w.n AND p.g = w.g),
word AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _crc32(text: str) -> str:
    """Checksum of the UTF-8 bytes of a string: the register takes a byte, then eight shifts with the fixed polynomial 0xEDB88320."""
    octets = f"list_transform(generate_series(1, strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k - 1, 2) AS BIGINT))"
    shifts = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {shifts}))"


def _variants() -> str:
    return f"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT doc_id, w, COUNT(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS named FROM run WHERE length(w) >= 7 GROUP BY doc_id, w),
summed AS (SELECT w, c, {_crc32('named')} AS h FROM each),
counted AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM summed),
word AS MATERIALIZED (SELECT w, CAST(SUM(c) AS BIGINT) AS n FROM counted WHERE length(w) >= 7 GROUP BY w HAVING SUM(c) >= 2),
del AS MATERIALIZED (SELECT w, n, k, substr(w, 1, k - 1) || substr(w, k + 1) AS v FROM (SELECT w, n, unnest(generate_series(1, length(w))) AS k FROM word)),
longer AS MATERIALIZED (SELECT DISTINCT d.w AS a, d.n AS an, x.w AS b, x.n AS bn FROM del d JOIN word x ON d.v = x.w),
near AS (SELECT d.w, e.w AS v, e.n AS m FROM del d JOIN del e ON d.k = e.k AND d.v = e.v WHERE d.w <> e.w
    UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
best AS (SELECT w, COUNT(*) AS n_near, MIN(struct_pack(less := -m, v := v)) AS top FROM near GROUP BY w),
formed AS MATERIALIZED (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * n THEN top.v END AS form, CASE WHEN -top.less >= 10 * n THEN -top.less END AS form_n
    FROM word LEFT JOIN best USING (w)),
chain AS (SELECT w, w AS last, 0 AS step FROM formed UNION ALL SELECT c.w, f.form, c.step + 1 FROM chain c JOIN formed f ON c.last = f.w WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT w, arg_max(last, step) AS root FROM chain GROUP BY w) r USING (w)"""


def _chunks() -> str:
    return r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, MIN(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)"""


def _conversations() -> str:
    """All conversations row by row: per state the least (cost, audit), whole audits and repaired turns carried along."""
    insert = "(0, 0, ''), (0, 2, 'u'), (0, 3, 'ua'), (1, 1, ''), (1, 2, 'u'), (1, 3, 'ua'), (2, 2, ''), (2, 3, 'a'), (3, 3, ''), (3, 2, 'u')"
    turns = "[CASE WHEN x = 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(made, '') IF x <> '']"
    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations),
marked AS MATERIALIZED (SELECT *, {_crc32('named')} % 20 AS d FROM src),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked WHERE d <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[ 	-]+$', '') AS body FROM damaged),
fault AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
totals AS (SELECT conv_id, CAST(coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS BIGINT) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
    COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated,
    COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, MAX(i) AS last FROM fault GROUP BY conv_id),
ins(p, s, made) AS (VALUES {insert}),
read(s, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit AS (SELECT s, 'D' AS e, '' AS c, s AS q, 4 AS price FROM (SELECT DISTINCT s FROM ins) UNION ALL SELECT s, 'K', c, q, 0 FROM read UNION ALL SELECT s, 'R', c, q, 3 FROM read WHERE c <> 's'),
move AS MATERIALIZED (SELECT p, made, {turns} AS new, e, c, q, price + 3 * length(made) AS price FROM ins JOIN edit USING (s)),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, struct_pack(cost := 0, audit := '', turns := CAST([] AS VARCHAR[])) AS way FROM totals
    UNION ALL
    SELECT b.conv_id, f.i, m.q, MIN(struct_pack(cost := b.way.cost + m.price + CASE WHEN m.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, audit := b.way.audit || repeat('I', length(m.made)) || m.e,
        turns := list_concat(list_concat(b.way.turns, m.new), CASE m.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
            ELSE [CASE WHEN m.c = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END)))
    FROM best b JOIN fault f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1 JOIN move m ON m.p = b.q
    WHERE m.e = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.e = 'R' OR m.c = substr(f.role, 1, 1)))
    GROUP BY b.conv_id, f.i, m.q),
ended AS (SELECT b.conv_id, MIN(struct_pack(cost := b.way.cost + 3 * length(n.made), audit := b.way.audit || repeat('I', length(n.made)), turns := list_concat(b.way.turns, {turns.replace('made', 'n.made')}))) AS way
    FROM best b JOIN totals t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.last JOIN ins n ON n.p = b.q WHERE n.s IN (0, 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
    CAST(coalesce(e.way.cost, 0) AS BIGINT) AS cost, coalesce(e.way.audit, '') AS audit, sha256(coalesce(array_to_string(e.way.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN totals t ON o.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES: dict[str, str] = {"op4_sharding": _sharding(), "op5_decontamination": _decontamination(), "op11_variants": _variants(), "op12_exact_duplicates": _chunks(),
                           "op13_conversations": _conversations()}
