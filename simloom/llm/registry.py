"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from simloom.llm.audio import op6_audio_fingerprints
from simloom.llm.chat import op10_chat_formatting
from simloom.llm.decontaminate import op2_decontamination
from simloom.llm.html_text import op8_html_text
from simloom.llm.language_id import op7_language_id
from simloom.llm.ngram_join import op4_ngram_jaccard
from simloom.llm.packing import op5_best_fit_packing
from simloom.llm.quality import op3_quality
from simloom.llm.tokens import op1_token_counts
from simloom.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_quality, op4_ngram_jaccard, op5_best_fit_packing, op6_audio_fingerprints, op7_language_id, op8_html_text, op9_toxicity, op10_chat_formatting)}

ORACLE_SQL = {
    "op2_decontamination": r"""
        WITH texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        words AS (SELECT kind, id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM texts),
        lens AS (SELECT DISTINCT len(w) AS l FROM words WHERE kind = 1 AND len(w) BETWEEN 1 AND 4 UNION SELECT 5),
        grams AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i : i + l - 1], ' '))) AS g FROM words, lens WHERE CASE WHEN kind = 1 THEN l = least(len(w), 5) ELSE len(w) >= l END),
        items AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE kind = 1)
        SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n_item) AS containment
        FROM grams d JOIN items i USING (g) WHERE d.kind = 0 GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n_item) * 80""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        low AS (SELECT doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM words),
        grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM low),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN links ON b = x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op10_chat_formatting": r"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        sized AS (SELECT *,
            length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]')) + length(role) + 17 AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM said),
        run AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last FROM sized)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(upto) FILTER (role = 'assistant' OR k = last)::BIGINT AS formatted_chars
        FROM run GROUP BY conv_id""",
}
