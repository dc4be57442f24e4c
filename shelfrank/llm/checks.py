"""DuckDB SQL for the queries whose rows SQL can give; written from their contracts alone."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 by its definition, a table made by rule and a fold over the bytes.
_CRC_TABLE = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i) AS n) AS r)"


def _crc32(text: str) -> str:
    """Of a text's UTF-8 bytes; ``t`` is the table."""
    digits = f"hex(encode({text}))"
    places = f"range(1, length({digits}), 2)"
    values = f"list_transform({places}, lambda p: ('0x' || substr({digits}, p, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def op2(shards: int, run_rows: int) -> str:
    def cost(s):
        return f"-ln((('0x' || substr(md5(concat(doc_id, '/{s}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"

    def first(n):
        return f"list_position([{', '.join(cost(s) for s in range(n))}], least({', '.join(cost(s) for s in range(n))})) - 1"

    return f"""WITH crc AS {_CRC_TABLE},
      d AS (SELECT doc_id, COALESCE(text, '') AS body FROM documents),
      r AS (SELECT doc_id, CAST(strlen(body) + 8 AS BIGINT) AS size, CAST({_crc32('body')} AS BIGINT) AS text_crc32,
          CAST({first(shards)} AS INT) AS shard, CAST({first(shards + 1)} AS INT) AS grown_shard, {_crc32('CAST(doc_id AS VARCHAR)')} AS place FROM d, crc),
      m AS (SELECT max(n) // {run_rows} + 1 AS runs FROM (SELECT count(*) AS n FROM r GROUP BY shard) AS c)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place % runs, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM r, m"""


def op3() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    bits = "list_aggregate(list_transform(range(1, 41), lambda i: right(bin(('0x' || 'f' || substr(h, i, 1))::BIGINT), 4)), 'string_agg', '')"
    digest = f"list_aggregate(list_transform(range(0, 32), lambda i: substr({letters}, CAST(list_reduce(list_prepend(0, list_transform(range(1, 6), lambda k: substr(b, i * 5 + k, 1)::INT)), lambda x, y: 2 * x + y) AS INT) + 1, 1)), 'string_agg', '')"
    return f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
      h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p),
      b AS (SELECT page_id, n, last, {bits} AS b FROM h)
      SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {digest} AS payload_digest,
        CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def op5(window: int) -> str:
    words = _words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
      s AS (SELECT item, w, least({window}, len(w)) AS n FROM i WHERE len(w) > 0),
      win AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS body FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM s) AS a),
      d AS (SELECT doc_id, {words} AS w FROM documents),
      dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS body FROM (
          SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) AS sizes WHERE len(w) >= n) AS a),
      hit AS (SELECT doc_id, k, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.body = win.body),
      found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id),
      covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hit) AS c GROUP BY doc_id)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
        sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN found USING (doc_id) LEFT JOIN covered USING (doc_id)"""


def op6(size: int, percent: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
      g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE array_to_string(w[k : k + {size - 1}], ' ') END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS k FROM d WHERE len(w) > 0) AS a),
      n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
      c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS (SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * common >= {percent} * (p.n + q.n - common)),
      e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
      r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
      SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) AS m USING (doc_id)"""


def op11(shortest: int, fewest: int, ratio: int, erased: int) -> str:
    return f"""WITH RECURSIVE crc AS {_CRC_TABLE},
      runs AS (SELECT doc_id, run, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) AS a
          WHERE length(run) >= {shortest} GROUP BY doc_id, run),
      hashed AS (SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h FROM runs, crc),
      results AS (SELECT n, CASE WHEN h % {erased} = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word FROM hashed),
      w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size FROM results WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {fewest}),
      less AS (SELECT word, n, size, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, size, unnest(range(1, size + 1)) AS i FROM w) AS p),
      one AS (SELECT a.word, b.word AS other, b.n FROM less AS a JOIN less AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND a.size = b.size),
      two AS (SELECT DISTINCT w.word, w.n, less.word AS longer, less.n AS longer_n FROM w JOIN less ON less.rest = w.word),
      near AS (SELECT word, other, n FROM one UNION ALL SELECT word, longer, longer_n FROM two UNION ALL SELECT longer, word, n FROM two),
      best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
      first AS (SELECT near.word, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.n = best.top GROUP BY near.word),
      f AS (SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN top >= {ratio} * w.n THEN other END AS form, CASE WHEN top >= {ratio} * w.n THEN top END AS form_n
        FROM w LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
      way(word, ending, form) AS (SELECT word, word, form FROM f UNION ALL SELECT way.word, f.word, f.form FROM way JOIN f ON f.word = way.form)
      SELECT f.word, f.form, way.ending AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word AND way.form IS NULL"""


def op13() -> str:
    said = "'</s>[INST] ok [/INST]'"

    def marks(text):
        return " + ".join(f"(length({text}) - length(replace({text}, '{m}', ''))) // {len(m)}" for m in ("<s>", "</s>", "[INST]", "[/INST]", "\\"))

    size = f"length(role) + length(body) + length('<s>[INST][/INST]</s>') + {marks('role')} + {marks('body')}"
    loss = "COALESCE(string_agg(body, '' ORDER BY turn) FILTER (role = 'assistant'), '')"
    return f"""WITH c AS (SELECT conv_id, turn, role, COALESCE(text, '') AS body FROM conversations
        UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said})
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), body, chr(10)), '' ORDER BY turn)) AS turns_sha256,
        CAST(length({loss}) AS BIGINT) AS loss_chars, sha256({loss}) AS loss_sha256, CAST(sum({size}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""
