"""DuckDB SQL for the later queries of this subpackage. DuckDB has no crc32, so its table is worked out in SQL."""

from __future__ import annotations

_TABLE = """crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""
#: Of texts whose letters are below U+0100, in a query that has crc's tab.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END))::UBIGINT[]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"""

OP11 = f"""WITH RECURSIVE {_TABLE},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, k, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT DISTINCT word, n, word[1 : i - 1] || word[i + 1 :] AS short FROM places),
one AS (SELECT a.word AS a, b.word AS b FROM places a JOIN places b ON a.i = b.i AND length(a.word) = length(b.word) AND a.word[1 : a.i - 1] || '*' || a.word[a.i + 1 :] = b.word[1 : b.i - 1] || '*' || b.word[b.i + 1 :] AND a.word <> b.word
  UNION ALL SELECT less.word, v.word FROM less JOIN v ON less.short = v.word UNION ALL SELECT v.word, less.word FROM less JOIN v ON less.short = v.word),
best AS (SELECT a AS word, count(*) AS n_near, min((-n, b)) AS x FROM one JOIN v ON one.b = v.word GROUP BY a),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -x[1] >= 2 * v.n THEN x[2] END AS form, CASE WHEN -x[1] >= 2 * v.n THEN -x[1] END::BIGINT AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS up FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON up = forms.word WHERE form IS NOT NULL),
ends AS (SELECT walk.word, up AS root FROM walk JOIN forms ON up = forms.word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

OP12 = """WITH docs AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cover AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) r(o) GROUP BY doc_id),
m AS (SELECT docs.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words FROM docs LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  concat_ws(',', CASE WHEN n_words < 50 OR n_words > 1000000 THEN 'length' END, CASE WHEN 100 * word_chars NOT BETWEEN 200 * n_words AND 1200 * n_words THEN 'word_length' END, CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
  CASE WHEN 100 * n_stop_words NOT BETWEEN 2 * n_words AND 90 * n_words THEN 'stop_words' END, CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 'repeated_lines' END) AS broken FROM m)
SELECT *, NOT base_failed AND broken = '' AS kept FROM b"""

OP13 = f"""WITH {_TABLE},
hashed AS (SELECT l.*, {_CRC.format("coalesce(sale_id::VARCHAR, '') || ',' || coalesce(item_id::VARCHAR, '') || ',' || coalesce(vendor_id::VARCHAR, '') || ',' || coalesce(line_no::VARCHAR, '')")} AS h FROM sale_lines l, crc),
dated AS (SELECT *, CASE WHEN shipped_at IS NULL THEN 19723 + h % 150 ELSE date_diff('day', DATE '1970-01-01', shipped_at::DATE) END AS s FROM hashed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
cut AS (SELECT *, greatest(1, least(12, 1 + (a - 19723) * 12 // 180)) AS b FROM arrived),
ends AS (SELECT b, max(max(s)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS largest FROM cut GROUP BY b),
sums AS (SELECT v.nation_id, c.item_id, a, b, sum(CASE flag WHEN 'returned' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0)) AS cents
  FROM cut c JOIN ends USING (b) JOIN vendors v ON c.vendor_id = v.vendor_id JOIN items i ON c.item_id = i.item_id WHERE v.nation_id IS NOT NULL AND (largest IS NULL OR s + 8 >= largest) GROUP BY ALL),
days AS (SELECT nation_id, a, b, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS k FROM (SELECT DISTINCT nation_id, a, b FROM sums)),
runs AS (SELECT nation_id, item_id, k, sum(cents) OVER w AS r, lead(k) OVER w AS until FROM sums JOIN days USING (nation_id, a) WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY k)),
boards AS (SELECT nation_id, k, item_id, row_number() OVER (PARTITION BY nation_id, k ORDER BY r DESC, item_id) AS rank FROM (SELECT d.nation_id, d.k, item_id, r FROM days d JOIN runs x ON d.nation_id = x.nation_id AND d.k >= x.k AND (x.until IS NULL OR d.k < x.until) WHERE r > 0) QUALIFY rank <= 10),
moves AS (SELECT coalesce(n.nation_id, o.nation_id) AS nation_id, coalesce(n.k, o.k + 1) AS k, coalesce(n.item_id, o.item_id) AS item_id, o.rank AS old_rank, n.rank AS new_rank FROM boards n FULL JOIN boards o ON n.nation_id = o.nation_id AND n.k = o.k + 1 AND n.item_id = o.item_id WHERE n.rank IS DISTINCT FROM o.rank)
SELECT m.nation_id, d.a::BIGINT AS arrival_day, m.item_id, d.b::INT AS batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank::INT AS old_rank, new_rank::INT AS new_rank, r::BIGINT AS revenue
FROM moves m JOIN days d USING (nation_id, k) JOIN runs x ON m.nation_id = x.nation_id AND m.item_id = x.item_id AND m.k >= x.k AND (x.until IS NULL OR m.k < x.until)"""
