"""DuckDB SQL of the training-data operators that SQL can express; importing it needs no library."""

CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), steps AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), checked AS (
  SELECT *, (before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS fits FROM steps
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(5 + length(replace(replace(replace(role, '\', '\\'), '|', '\p'), '>', '\g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 8) AS BIGINT) AS formatted_chars,
  bool_and(fits) AS valid,
  bool_and(fits) AND bool_or(role = 'assistant' AND pos = n) AS complete
FROM checked GROUP BY conv_id
"""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT pairs.b, reach.c FROM reach JOIN pairs ON pairs.a = reach.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SOURCE_AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT lang, source, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS d FROM words GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS all_n FROM counts GROUP BY ALL HAVING sum(d) >= 3
), groups AS (SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, source, (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v,
    (SELECT coalesce(sum(n), 0) FROM counts c JOIN kept k USING (lang, term) WHERE c.lang = g.lang AND c.source = g.source)::HUGEINT AS total,
    (SELECT coalesce(sum(all_n), 0) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS lang_total FROM groups g
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 1)) // (lang_total + v) AS q
  FROM sizes s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INT) AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""


def merkle_manifest(levels: int = 8, groups: int = 3) -> str:
    """SQL for up to 8 ** levels rows of a language and 8 ** groups languages: a level of nodes and of siblings after the other."""

    def tree(name: str, count: int) -> str:
        """Nodes name_0(tree, pos, h) hashed upwards; a tree's only node stays as it is and has no siblings."""
        steps = []
        for k in range(count):
            steps.append(f"""{name}_s{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {name}_{k}
), {name}_g{k} AS (SELECT tree, pos // 8 AS pos, any_value(m) AS m, list(h ORDER BY pos) AS run FROM {name}_s{k} GROUP BY tree, pos // 8
), {name}_{k + 1} AS (SELECT tree, pos, CASE WHEN m = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}_g{k})""")
        return ", ".join(steps)

    def walk(name: str, to: str, count: int, start: str) -> str:
        """Rows of start (tree, at, ..., proof, folded) taken up the tree."""
        steps, before = [], start
        for k in range(count):
            left, right = f"array_to_string(g.run[1 : (r.spot // {8**k}) % 8], '')", f"array_to_string(g.run[(r.spot // {8**k}) % 8 + 2 :], '')"
            steps.append(f"""{to}_{k} AS (SELECT r.* EXCLUDE (proof, folded), CASE WHEN g.m = 1 THEN r.proof ELSE r.proof || {left} || {right} END AS proof,
  CASE WHEN g.m = 1 THEN r.folded ELSE sha256({left} || r.folded || {right}) END AS folded
  FROM {before} r JOIN {name}_g{k} g ON g.tree = r.tree AND g.pos = r.spot // {8 ** (k + 1)})""")
            before = f"{to}_{k}"
        return ", ".join(steps)

    def told(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(told(c) for c in ('d.doc_id', 'source', 'lang', 'n_chars'))} || {told(text)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"""
WITH RECURSIVE crc(doc_id, s, x, k) AS (
  SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, ''), 4294967295::BIGINT, 0 FROM documents
  UNION ALL
  SELECT doc_id, s, {step}, k + 1 FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::BIGINT) ELSE x END AS x FROM crc WHERE k < 8 * length(s))
), sums AS (SELECT doc_id, xor(x, 4294967295) AS crc FROM crc WHERE k = 8 * length(s)
), leaves AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, CASE WHEN s.crc % 3 = 0 THEN {leaf(lowered)} END AS tampered
  FROM documents d JOIN sums s ON s.doc_id IS NOT DISTINCT FROM d.doc_id
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves
), n_0 AS (SELECT tree, spot AS pos, leaf AS h FROM placed
), {tree("n", levels)}
, ends AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM n_{levels}
), t_0 AS (SELECT 0 AS tree, place AS pos, subroot AS h FROM ends
), {tree("t", groups)}
, begun AS (SELECT *, '' AS proof, coalesce(tampered, leaf) AS folded FROM placed
), {walk("n", "up", levels, "begun")}
, middle AS (SELECT u.doc_id, u.leaf, e.subroot, 0 AS tree, e.place AS spot, u.proof, u.folded FROM up_{levels - 1} u JOIN ends e USING (tree)
), {walk("t", "top", groups, "middle")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM top_{groups - 1}, (SELECT h AS root FROM t_{groups})
"""
