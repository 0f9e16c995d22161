"""DuckDB twins. They state the rules anew and take no constant from the operators."""

from __future__ import annotations

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p
"""

VECTORS_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
) WHERE rank <= 20
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
),
hits AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.words = x.words),
hit_words AS (
  SELECT doc_id, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

#: Words as they stand, and what lies between them; a word is hit if a window covers it.
DECONTAMINATED_SQL = DECONTAMINATION_SQL[:DECONTAMINATION_SQL.index("hit_words AS (")] + r"""
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM hits),
cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w,
         regexp_split_to_array(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS between FROM documents
),
pieces AS (
  SELECT c.doc_id, n, w[n] AS word, between[n] AS before, p.place IS NOT NULL AS hit
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM cut) c LEFT JOIN places p ON p.doc_id = c.doc_id AND p.place = c.n
),
kept AS (
  SELECT doc_id, count(*) FILTER (hit) AS n_cut, string_agg(part, '' ORDER BY n) AS text FROM (
    SELECT *, CASE WHEN hit AND lag(hit, 1, false) OVER (PARTITION BY doc_id ORDER BY n) THEN '' ELSE before END || CASE WHEN hit THEN '' ELSE word END AS part FROM pieces
  ) GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n_cut, 0)::BIGINT AS n_cut, length(coalesce(k.text, '') || between[len(between)])::BIGINT AS kept_chars,
       sha256(coalesce(k.text, '') || between[len(between)]) AS kept_sha256
FROM cut c LEFT JOIN kept k USING (doc_id)
"""

_ESCAPED = (
    "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '~', '~t'), '<|', '~b'), '|>', '~e'), "
    "'</s>', '~z'), '<s>', '~s'), '[INST]', '~i'), '[/INST]', '~j'), '<<SYS>>', '~y'), '<</SYS>>', '~x')"
)

CHAT_SQL = f"""
WITH raw AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (
  SELECT *, greatest(ceil(strlen(text) / 4.0), 1)::BIGINT AS tokens, row_number() OVER c - 1 AS n,
         8 + length(role) + 1 + length({_ESCAPED.format("text")}) + 7 AS size
  FROM raw WINDOW c AS (PARTITION BY conv_id ORDER BY turn)
),
s AS (SELECT conv_id, tokens AS own, size AS own_size FROM t WHERE n = 0 AND role = 'system' AND tokens <= (1024 - 256) / 2),
p AS (
  SELECT t.*, coalesce(own, 0) AS own, coalesce(own_size, 0) AS own_size, own IS NOT NULL AS sys,
         sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY n) - tokens AS before
  FROM t LEFT JOIN s USING (conv_id)
),
w AS (SELECT *, floor(greatest(before - own, 0) / greatest(floor((1024 - 256 - own) / 2), 1)) AS win FROM p),
starts AS (
  SELECT conv_id, win, min(n) AS first, min(before) AS first_before, max(own_size) AS own_size, bool_or(sys) AS sys
  FROM w GROUP BY ALL HAVING min(n) > 0
),
past AS (
  SELECT st.conv_id, sum(w.size) AS size FROM starts st
  JOIN w ON w.conv_id = st.conv_id AND w.n < st.first AND w.n >= st.first - 2 AND NOT (st.sys AND w.n = 0)
  WHERE st.first_before - w.before <= 256 GROUP BY st.conv_id
),
again AS (SELECT conv_id, sum(own_size) AS size FROM starts GROUP BY conv_id)
SELECT w.conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(w.size) + coalesce(any_value(past.size), 0) + coalesce(any_value(again.size), 0))::BIGINT AS formatted_chars
FROM w LEFT JOIN past ON past.conv_id = w.conv_id LEFT JOIN again ON again.conv_id = w.conv_id
GROUP BY w.conv_id
"""

ROLLUP_SQL = r"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[0-9]|[A-Za-z]+')) AS runs
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
)
SELECT source, lang, 'words' AS tokenizer, count(*)::BIGINT AS docs, sum(words)::BIGINT AS tokens FROM d GROUP BY ALL
UNION ALL
SELECT source, lang, 'runs', count(*)::BIGINT, sum(runs)::BIGINT FROM d GROUP BY ALL
"""

_TEMPLATES = """
(0, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
(1, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
(2, 'Apache-2.0', 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/'),
(3, 'BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:'),
(4, 'BSD-3-Clause', 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.'),
(5, 'CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
(6, 'CC-BY-4.0', 'Licensed under CC BY 4.0.'),
(7, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
(8, 'CC-BY-NC-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
(9, 'CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
(10, 'CC0-1.0', 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.'),
(11, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
(12, 'GPL-3.0', 'GNU General Public License Version 3, 29 June 2007'),
(13, 'GPL-3.0', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
(14, 'LGPL-3.0', 'GNU Lesser General Public License Version 3, 29 June 2007'),
(15, 'MIT', 'Released under the MIT License.'),
(16, 'MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
(17, 'MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
(18, 'Unlicense', 'This is free and unencumbered software released into the public domain.')
"""

LICENCE_SQL = rf"""
WITH templates(template, name, text) AS (VALUES {_TEMPLATES}),
tt AS (SELECT template, name, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates),
t_count AS (SELECT template, name, term, count(*) AS n FROM tt GROUP BY ALL),
files AS (
  SELECT doc_id, coalesce(text, '') AS text,
         concat_ws('/', CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/' || (doc_id % 100)::VARCHAR END,
                   CASE WHEN doc_id % 5 = 0 THEN 'LICENSE-' || doc_id::VARCHAR ELSE doc_id::VARCHAR || '.txt' END) AS path
  FROM documents
),
df AS (
  SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+')) AS term FROM files)
  GROUP BY term
),
total AS (SELECT count(*) AS files FROM files),
idf AS (
  SELECT term, ln((1 + files) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf
  FROM (SELECT term FROM t_count UNION SELECT term FROM df) LEFT JOIN df USING (term), total
),
t_weight AS (
  SELECT template, name, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS weight FROM t_count JOIN idf USING (term)
),
segments AS (
  SELECT doc_id, 'l' || i AS spot, parts[i] AS segment FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM files))
  UNION ALL
  SELECT doc_id, 'p' || i, parts[i] FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n[\x20\t\r]*\n') AS parts FROM files))
  WHERE contains(parts[i], chr(10))
),
counted AS (
  SELECT doc_id, spot, term, count(*) AS n FROM (SELECT doc_id, spot, unnest(regexp_extract_all({_LOWER.format("segment")}, '[a-z0-9]+')) AS term FROM segments) GROUP BY ALL
),
weighed AS (SELECT doc_id, spot, term, n * idf AS w FROM counted JOIN idf USING (term)),
norms AS (SELECT doc_id, spot, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
cosines AS (
  SELECT doc_id, name, round(sum(w * weight) / any_value(norm), 9) AS cosine
  FROM weighed JOIN t_weight USING (term) JOIN norms USING (doc_id, spot) GROUP BY doc_id, spot, template, name
),
own AS (
  SELECT doc_id, name AS licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, name) AS r FROM cosines WHERE cosine >= 0.8) WHERE r = 1
),
dirs AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, o.licence, o.cosine FROM files LEFT JOIN own o USING (doc_id)),
licensed AS (
  SELECT dir, licence FROM (SELECT dir, licence, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) AS r FROM dirs WHERE licence IS NOT NULL AND doc_id % 5 = 0) WHERE r = 1
),
above AS (
  SELECT dir, licence, from_dir FROM (
    SELECT d.dir, l.licence, l.dir AS from_dir, row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) AS r
    FROM (SELECT DISTINCT dir FROM dirs) d JOIN licensed l ON d.dir = l.dir OR starts_with(d.dir, l.dir || '/')
  ) WHERE r = 1
)
SELECT doc_id, path, coalesce(d.licence, a.licence) AS licence,
       CASE WHEN d.licence IS NOT NULL THEN 'own' WHEN a.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN d.licence IS NULL THEN a.from_dir END AS from_dir, round(d.cosine, 6) AS cosine
FROM dirs d LEFT JOIN above a ON a.dir = d.dir
"""

_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")

LINES_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
k AS (SELECT *, {_KEY} AS line_key FROM l),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY line_key) AS first_id FROM k),
x AS (SELECT *, length(line_key) >= 10 AND doc_id <> first_id AS gone FROM f)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""

PIECES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS x FROM documents
),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3,
         ('0x' || x[25:32])::BIGINT AS h4
  FROM d
),
f AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_NORMAL = _LOWER.format(r"regexp_replace(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]', '0', 'g')")

RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, source, t, i, parts[i] AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(t, chr(10)) AS parts FROM d))),
k AS (
  SELECT *, {_NORMAL} AS line_key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
twice AS (SELECT doc_id, count(*) AS n FROM k WHERE nth > 1 GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i:i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
again AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS place FROM r WHERE n > 1) GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n_host FROM d WHERE len(w) > 0 GROUP BY source),
counted AS (SELECT source, line_key, count(DISTINCT t) AS n_docs FROM k GROUP BY ALL),
above AS (SELECT c.source, c.line_key FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n_docs > 10 AND 100 * n_docs > n_host),
gone AS (SELECT doc_id, sum(size) AS n FROM k JOIN above a ON k.line_key = a.line_key AND k.source IS NOT DISTINCT FROM a.source GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(twice.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed
  FROM d LEFT JOIN twice USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (removed > 0 AND (2 * removed > n_words OR n_words - removed < 50)) AS kept, removed::BIGINT AS removed_words
FROM b
"""

_CRC = (
    "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT), lambda c, b: "
    "list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"
)


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


#: A path is {c: cost, a: audit}; a list of four holds the best path from each node, given the rows to come.
_AHEAD = "{{'c': ({0}).c + {1}, 'a': '{2}' || ({0}).a}}"
_GOES = "x.f IN ('blank', 'duplicate')"
_WELL = "CASE WHEN x.f = 'truncated' THEN 3 ELSE 0 END"
_NEVER = "{'c': 1000000000, 'a': ''}"


def _row(node: int, due: int, kept: list[tuple[str, int]]) -> str:
    """The best way through one row from a node: delete, give the role that is due, or keep."""
    ways = [_AHEAD.format(f"p[{node}]", "4", "D"), f"CASE WHEN {_GOES} THEN {_NEVER} ELSE {_AHEAD.format(f'p[{due}]', '3 + ' + _WELL, 'R')} END"]
    ways += [f"CASE WHEN {_GOES} OR x.r <> '{r}' THEN {_NEVER} ELSE {_AHEAD.format(f'p[{to}]', _WELL, 'K')} END" for r, to in kept]
    return _best(*ways)


_OWN = "[" + ", ".join([_row(1, 3, [("s", 2), ("u", 3)]), _row(2, 3, [("u", 3)]), _row(3, 4, [("a", 4)]), _row(4, 3, [("u", 3)])]) + "]"
_ONCE = "list_transform([3, 3, 4, 3], lambda n: {'c': o[n].c + 3, 'a': 'I' || o[n].a})"
_TWICE = "list_transform([4, 4, 3, 4], lambda n: {'c': o[n].c + 6, 'a': 'II' || o[n].a})"
_STEP = (
    f"list_transform([{_OWN}], lambda o: list_transform(list_zip(o, {_ONCE}, {_TWICE}), lambda z: {_best('z[1]', 'z[2]', 'z[3]')}))[1]"
)

STRUCTURE_SQL = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
),
k AS (SELECT *, {_CRC.format("name")} % 20 AS kind FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid
  FROM damaged
),
marked AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'well' END AS f,
         lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r AS pair
  FROM placed
),
folded AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
         count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'role': role, 'text': text, 'r': r}} ORDER BY pos) AS rows,
         list_reduce(list({{'f': f, 'r': r}} ORDER BY pos DESC), lambda p, x: {_STEP},
                     [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}])[1] AS best
  FROM marked GROUP BY conv_id
),
letters AS (
  SELECT conv_id, rows, letter, i, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS made
  FROM (SELECT conv_id, rows, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS i, unnest(string_split(best.a, '')) AS letter FROM folded WHERE best.a <> '')
),
edits AS (
  SELECT *, CASE WHEN letter = 'K' THEN rows[pos].role WHEN (made - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
            || CASE WHEN letter = 'I' THEN '' ELSE rows[pos].text END AS line
  FROM (SELECT *, max(CASE WHEN letter = 'K' AND rows[pos].r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM letters) WHERE letter <> 'D'
),
joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM edits GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN folded f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
"""
