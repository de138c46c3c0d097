"""SQL for the queries that SQL can express."""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_BENCHMARK = f"""
WITH item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc
), found AS (
  SELECT place.doc_id, place.i, phrase.n, phrase.item_id
  FROM (SELECT DISTINCT n FROM phrase) size
  JOIN place ON place.i + size.n - 1 <= len(place.w)
  JOIN phrase ON phrase.n = size.n
    AND phrase.phrase = array_to_string(place.w[place.i : place.i + size.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON hit.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id
"""

_LINE_KEY = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_LINES = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line_rows AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split
), keyed AS (
  SELECT doc_id, place, line, {_LINE_KEY} AS key FROM line_rows
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

_CRC_TABLE = (
    "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, _: "
    "if(c & 1 = 1, xor(3988292384, c >> 1), c >> 1)))"
)


def _crc32(text: str, table: str) -> str:
    """CRC-32 of a text of ASCII characters, byte by byte over the table of its 256 remainders."""
    codes = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), "
        f"lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)))"
    )


def _lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# Levels grow by recursion until a tree has one node; trees of sources first, then the one over them.
_NODES = """{name}(tree, level, idx, digest, size) AS (
  {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)),
         (any_value(size) + 15) // 16
  FROM {name} WHERE size > 1 GROUP BY tree, level, idx // 16
)"""
_MANIFEST = f"""
WITH RECURSIVE crc AS (
  SELECT {_CRC_TABLE} AS remainders
), leaf AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         if({_crc32("CAST(doc_id AS VARCHAR)", "remainders")} % 5 = 0, {_leaf(_lowered("text"))}, NULL)
           AS changed
  FROM documents, crc
), tree AS (
  SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, count(*) AS size
  FROM leaf GROUP BY source
), placed AS (
  SELECT doc_id, leaf, changed, tree, size,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx
  FROM leaf JOIN tree ON leaf.source IS NOT DISTINCT FROM tree.source
), {_NODES.format(name="below", leaves="SELECT tree, 0, idx, leaf, size FROM placed")},
{_NODES.format(
    name="above",
    leaves="SELECT -1, 0, tree, digest, (SELECT count(*) FROM tree) FROM below WHERE size = 1",
)}, node AS (
  SELECT * FROM below WHERE size > 1 UNION ALL SELECT * FROM above
), way AS (
  -- Where a leaf's way to the root goes: step, tree, level and place.
  SELECT doc_id, tree AS own, leaf, changed, 0 AS step,
         if(size > 1, tree, -1) AS at_tree, 0 AS level, if(size > 1, idx, tree) AS idx,
         size, coalesce(changed, leaf) AS digest
  FROM placed
  UNION ALL
  SELECT doc_id, own, any_value(leaf), any_value(changed), step + 1,
         if(any_value(next_size) > 1 OR at_tree = -1, at_tree, -1),
         if(any_value(next_size) > 1 OR at_tree = -1, level + 1, 0),
         if(any_value(next_size) > 1 OR at_tree = -1, idx // 16, own),
         any_value(next_size), sha256(string_agg(member, '' ORDER BY member_idx))
  FROM (
    SELECT way.*, node.idx AS member_idx, (node.size + 15) // 16 AS next_size,
           if(node.idx = way.idx, way.digest, node.digest) AS member
    FROM way JOIN node ON node.tree = way.at_tree AND node.level = way.level
      AND node.idx // 16 = way.idx // 16 AND node.size > 1)
  GROUP BY doc_id, own, step, at_tree, level, idx
), sibling AS (
  SELECT way.doc_id, way.own, string_agg(node.digest, '' ORDER BY step, node.idx) AS siblings
  FROM way JOIN node ON node.tree = way.at_tree AND node.level = way.level
    AND node.idx // 16 = way.idx // 16 AND node.size > 1 AND node.idx <> way.idx
  GROUP BY way.doc_id, way.own
), folded AS (
  SELECT doc_id, own, max_by(digest, step) AS folded_root FROM way GROUP BY doc_id, own
)
SELECT placed.doc_id, leaf, subroot.digest AS subroot, top.digest AS root,
       sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = top.digest AS verified
FROM placed
JOIN (SELECT idx, digest FROM above WHERE level = 0) subroot ON subroot.idx = placed.tree
JOIN (SELECT digest FROM above WHERE size = 1) top ON true
JOIN folded ON folded.doc_id = placed.doc_id AND folded.own = placed.tree
LEFT JOIN sibling ON sibling.doc_id = placed.doc_id AND sibling.own = placed.tree
"""

ORACLES = {
    "op5_decontamination": _BENCHMARK,
    "op4_exact_top_k": _TOP_K,
    "op6_line_dedup": _LINES,
    "op11_merkle_manifest": _MANIFEST,
}
