"""DuckDB SQL for the corpus queries that SQL can express.

The others (a Hilbert order, fixed-point prefix sums over hashed ties, trained models, components)
are tested against brute force, by law or by held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from . import licences


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SENTENCES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licences.SENTENCES.items())
_RULES = ", ".join(f"({i}, {_quoted(licence)}, [{', '.join(map(_quoted, ids))}])" for i, (licence, ids) in enumerate(licences.RULES))

ORACLES: dict[str, str] = {
    "op2_chunk_recipe_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    # From the catalogue's sentences and rules as they stand; how they are cut, matched and ranked is said again here.
    "op5_licence_rules": rf"""
        WITH s(name, text) AS (VALUES {_SENTENCES}), rule(nr, licence, names) AS (VALUES {_RULES}),
        cut AS (SELECT name, list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?]+[\x09-\x0D\x20]+|[\x0A-\x0D]+'),
                    lambda x: trim(regexp_replace(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')), lambda x: x <> '') AS forms FROM s),
        part AS (SELECT name, unnest(range(1, len(forms) + 1)) AS i, len(forms) AS n, unnest(forms) AS form FROM cut),
        known AS (SELECT name, i, form, name || CASE WHEN n > 1 THEN '.' || i ELSE '' END AS id FROM part),
        step AS (SELECT nr, licence, unnest(range(1, len(names) + 1)) AS pos, unnest(names) AS name FROM rule),
        asks AS (SELECT nr, licence, count(*) AS n, ',' || string_agg(id, ',' ORDER BY pos, i) || ',' AS line,
                    ',' || string_agg(replace(id, '.', '[.]'), ',(.*,)?' ORDER BY pos, i) || ',' AS pattern FROM step JOIN known USING (name) GROUP BY 1, 2),
        wider AS (SELECT a.nr, b.nr AS beyond FROM asks a JOIN asks b ON a.licence <> b.licence AND b.n > a.n AND regexp_matches(b.line, a.pattern)),
        d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[.!?]+[\x09-\x0D\x20]+|[\x0A-\x0D]+'),
                    lambda x: trim(regexp_replace(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')) AS forms FROM documents),
        u AS (SELECT r, unnest(range(1, len(forms) + 1)) AS pos, unnest(forms) AS form FROM d),
        found AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM u JOIN known USING (form) GROUP BY r),
        held AS (SELECT r, nr, licence FROM found JOIN asks ON regexp_matches(',' || ids || ',', pattern)),
        names AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT r, licence FROM held h
                    WHERE NOT EXISTS (SELECT 1 FROM held o JOIN wider w ON w.beyond = o.nr WHERE o.r = h.r AND w.nr = h.nr)) GROUP BY r)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
        FROM d LEFT JOIN found USING (r) LEFT JOIN names USING (r)""",
    "op10_winnowing": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS gram
            FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
               FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
        hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, gram)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
