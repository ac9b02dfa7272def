"""DuckDB versions of the fixtures (FIXTURES.md section 3) as CTE bodies."""

FIXTURE_CTES = {
    "fx_essays": """
SELECT doc_id AS essay_id, text, n_chars,
       CASE n_chars % 6 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1'
                        WHEN 3 THEN 'B2' WHEN 4 THEN 'C1' ELSE 'C2' END || '.' || source AS cefr
FROM documents""",
    "fx_dirty": """
SELECT essay_id, cefr,
       CASE essay_id % 5 WHEN 0 THEN replace(text, ',', '，')
                         WHEN 1 THEN replace(text, ' the ', '  “the”   ')
                         WHEN 2 THEN '   ' || replace(text, '. ', ' —  ')
                         WHEN 3 THEN 'Hi' || chr(10) || chr(10) || 'all' || chr(10) || text || chr(10) || 'Bye' || chr(10)
                         ELSE text END AS text
FROM fx_essays""",
    "fx_toks": """
SELECT essay_id, i, w,
       CAST(sum(length(w) + 1) OVER (PARTITION BY essay_id ORDER BY i) - length(w) - 1 AS BIGINT) AS cs
FROM (SELECT essay_id, unnest(generate_series(0, len(a) - 1)) AS i, unnest(a) AS w
      FROM (SELECT essay_id, string_split_regex(text, '[ \n]') AS a FROM fx_essays))""",
    "fx_edits": """
SELECT essay_id, c.coder, i AS edit_no,
       cs + CASE WHEN i % 6 = 5 AND length(w) >= 3 THEN 1 ELSE 0 END AS s,
       CASE WHEN i % 4 = 2 THEN cs + CASE WHEN i % 6 = 5 AND length(w) >= 3 THEN 1 ELSE 0 END
            WHEN i % 5 IN (0, 3) THEN cs + length(w) + 6
            ELSE cs + length(w) END AS e,
       CASE WHEN i % 5 = 0 THEN NULL WHEN i % 4 = 2 THEN 'the'
            WHEN i % 4 = 3 THEN '' ELSE w || ' x' END AS cor,
       CASE WHEN i % 5 = 0 THEN NULL WHEN i % 4 = 2 THEN 'M:DET' WHEN i % 4 = 3 THEN 'U:ADV'
            WHEN i % 7 = 0 THEN 'R:VERB' WHEN i % 7 = 1 THEN 'R:NOUN'
            WHEN i % 7 = 2 THEN 'R:ADJ' WHEN i % 7 = 3 THEN 'R:ADV' ELSE 'R:SPELL' END AS cat
FROM fx_toks CROSS JOIN (SELECT 0 AS coder UNION ALL SELECT 1 AS coder) c
WHERE length(w) > 0
  AND ((c.coder = 0 AND (essay_id * 31 + i * 17) % 23 IN (0, 17))
    OR (c.coder = 1 AND essay_id % 10 = 0 AND (essay_id * 31 + i * 17) % 29 IN (0, 17)))""",
    "fx_coders": """
SELECT essay_id, c.coder FROM fx_essays CROSS JOIN (SELECT 0 AS coder UNION ALL SELECT 1 AS coder) c
WHERE c.coder = 0 OR essay_id % 10 = 0""",
    "fx_lexicon": """
SELECT word, CASE length(word) % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ'
                                   WHEN 3 THEN 'ADV' ELSE 'DET' END AS pos,
       lower(word) AS lemma, count(*) AS n
FROM (SELECT trim(w, '!"#$%&()*+,-./:;<=>?@[]^_`{|}~') AS word FROM fx_toks)
WHERE length(word) > 0 GROUP BY 1, 2, 3""",
    "fx_psy": """
SELECT word AS "Word",
       CASE pos WHEN 'NOUN' THEN 'Noun' WHEN 'VERB' THEN 'Verb' WHEN 'ADJ' THEN 'Adjective'
                WHEN 'ADV' THEN 'Adverb' ELSE 'Article' END AS "Dom_PoS_SUBTLEX",
       CAST(n AS VARCHAR(20)) AS "Freq_pm", CAST(3 + length(word) % 12 AS VARCHAR(20)) AS "AoA_Kup_lem"
FROM fx_lexicon WHERE word = lemma AND n % 3 <> 0""",
    "fx_cefr_vocab": """
SELECT word, CASE WHEN pos = 'VERB' AND n % 4 = 0 THEN 'be-verb' WHEN pos = 'NOUN' THEN 'noun'
                  WHEN pos = 'VERB' THEN 'verb' WHEN pos = 'ADJ' THEN 'adjective'
                  WHEN pos = 'ADV' THEN 'adverb' ELSE 'determiner' END AS pos,
       CASE length(word) % 6 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1'
                             WHEN 3 THEN 'B2' WHEN 4 THEN 'C1' ELSE 'C2' END AS cefr_j
FROM fx_lexicon WHERE n % 2 = 0""",
}
