"""Oracle SQL (DuckDB dialect) per registered query."""

from __future__ import annotations

from errata.constants import ASCII_PUNCT, PUNCT_FROM, PUNCT_TO, PY_WS
from errata.functions.text import TOKEN_RE
from errata.plans.oracle_fixtures import FIXTURE_CTES


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STRIP = lit("^" + PY_WS + "+|" + PY_WS + r"+\z")
WS = lit(PY_WS)
PUNCT = lit(ASCII_PUNCT)

CONTENT = "('VERB', 'NOUN', 'ADJ', 'ADV')"
SELECTED = "('R:VERB', 'R:NOUN', 'R:ADJ', 'R:ADV')"

def paragraph_ctes(src: str, p: str) -> dict[str, str]:
    """Paragraphs of ``src`` (essay_id, text) by the line rule, as windows."""
    return {
        f"{p}_lines": f"""
SELECT essay_id, text, CAST(k AS INTEGER) AS line_no, line,
       CAST(sum(length(line) + 1) OVER (PARTITION BY essay_id ORDER BY k) - length(line) - 1 AS INTEGER) AS l_start
FROM (SELECT essay_id, text, unnest(generate_series(0, len(a) - 1)) AS k, unnest(a) AS line
      FROM (SELECT essay_id, text, string_split(text, chr(10)) AS a FROM {src}))""",
        f"{p}_lkind": f"""
SELECT *, CASE WHEN slen > 25 THEN 2 WHEN slen > 0 THEN 1 ELSE 0 END AS kind
FROM (SELECT *, length(regexp_replace(line, {STRIP}, '', 'g')) AS slen FROM {p}_lines)""",
        f"{p}_lnl": f"""
SELECT *, sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY essay_id ORDER BY line_no) AS nl
FROM {p}_lkind""",
        f"{p}_lpara": f"""
SELECT *, CASE WHEN kshort <= 5 THEN greatest(nl, 1) ELSE nl + 1 END - 1 AS para_no
FROM (SELECT *, count(*) FILTER (WHERE kind = 1 AND nl = 0) OVER (PARTITION BY essay_id) AS kshort
      FROM {p}_lnl)""",
        f"{p}_paras": f"""
SELECT essay_id, para_no, p_start, p_end, substring(text, p_start + 1, p_end - p_start) AS para
FROM (SELECT essay_id, CAST(para_no AS INTEGER) AS para_no, CAST(min(l_start) AS INTEGER) AS p_start,
             CAST(least(max(l_start + length(line) + 1), max(length(text))) AS INTEGER) AS p_end,
             max(text) AS text
      FROM {p}_lpara GROUP BY essay_id, para_no HAVING max(kind) > 0)""",
        f"{p}_clean": f"""
SELECT *, regexp_replace(regexp_replace(para_ws, ' +', ' ', 'g'), '^ ', '') AS clean,
       left(para_ws, 1) = ' ' AS lead
FROM (SELECT *, regexp_replace(para, {WS}, ' ', 'g') AS para_ws FROM {p}_paras)""",
    }


# Shared derived CTEs, in dependency order (each may use earlier ones).
DERIVED_CTES = {
    "o_dirty_norm": f"""
SELECT essay_id, cefr, translate(text, {lit(PUNCT_FROM)}, {lit(PUNCT_TO)}) AS text FROM fx_dirty""",
    "o_essays_norm": f"""
SELECT essay_id, cefr, translate(text, {lit(PUNCT_FROM)}, {lit(PUNCT_TO)}) AS text FROM fx_essays""",
    "o_words": """
SELECT essay_id, i, w, cs, cs + length(w) AS ce FROM fx_toks WHERE length(w) > 0""",
    "o_word_labels": f"""
SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM fx_edits x WHERE x.essay_id = t.essay_id
                 AND x.coder = 0 AND x.cat IN {SELECTED} AND x.s < x.e
                 AND x.s < t.ce AND x.e > t.cs) THEN 'true' ELSE 'false' END AS label
FROM o_words t""",
    "o_tagged": """
SELECT l.*, CASE WHEN a.word IS NOT NULL THEN a.pos WHEN b.word IS NOT NULL THEN b.pos ELSE 'X' END AS pos,
       CASE WHEN a.word IS NOT NULL THEN a.lemma WHEN b.word IS NOT NULL THEN b.lemma ELSE l.w END AS lemma
FROM o_word_labels l LEFT JOIN fx_lexicon a ON a.word = l.w LEFT JOIN fx_lexicon b ON b.word = lower(l.w)""",
    "o_masked": f"""
SELECT essay_id, i, w, cs, ce, pos, lemma,
       CASE WHEN pos IN {CONTENT} THEN label ELSE 'NONE' END AS label FROM o_tagged""",
    "o_seqs": """
SELECT 'fx_' || CAST(m.essay_id AS VARCHAR) AS seq_id,
       string_agg(w, '|||' ORDER BY i) AS token_seq,
       string_agg(label, '|||' ORDER BY i) AS label_seq,
       left(max(e.cefr), 2) AS cefr, CAST(m.essay_id AS BIGINT) AS row_i
FROM o_masked m JOIN fx_essays e ON e.essay_id = m.essay_id GROUP BY m.essay_id""",
    **paragraph_ctes("o_dirty_norm", "o_np"),
    **paragraph_ctes("fx_dirty", "o_rp"),
    **paragraph_ctes("o_essays_norm", "o_ep"),
    "o_np_offs": """
SELECT essay_id, para_no, CAST(o AS INTEGER) AS o, para_ws, clean, lead
FROM (SELECT *, unnest(generate_series(0, length(para_ws))) AS o FROM o_np_clean)
WHERE o = 0 OR o = length(para_ws) OR substring(para_ws, o, 1) = ' ' OR substring(para_ws, o + 1, 1) = ' '""",
    "o_np_remap": """
SELECT *, CAST(CASE WHEN lead THEN greatest(r - 1, 0) ELSE r END AS INTEGER) AS o_clean
FROM (SELECT *, length(regexp_replace(substring(para_ws, 1, o), ' +', ' ', 'g'))
                - CASE WHEN o > 0 AND substring(para_ws, o, 1) = ' ' AND substring(para_ws, o + 1, 1) = ' '
                       THEN 1 ELSE 0 END AS r
      FROM o_np_offs)""",
    "o_np_tokens": f"""
SELECT essay_id, para_no, CAST(row_number() OVER (PARTITION BY essay_id, para_no ORDER BY k) - 1 AS INTEGER) AS tok_i,
       piece AS tok, CAST(cs AS INTEGER) AS cs, CAST(cs + length(piece) AS INTEGER) AS ce
FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY essay_id, para_no ORDER BY k) - length(piece) AS cs
      FROM (SELECT essay_id, para_no, unnest(generate_series(1, len(pc))) AS k, unnest(pc) AS piece
            FROM (SELECT essay_id, para_no, regexp_extract_all(clean, {lit(TOKEN_RE + "| +")}) AS pc
                  FROM o_np_clean WHERE clean <> '')))
WHERE left(piece, 1) <> ' '""",
    "o_trows": """
SELECT row_i, seq_id, cefr, sequence_length, CAST(feature_i AS INTEGER) AS feature_i,
       tk[feature_i + 1] AS token, lb[feature_i + 1] AS label
FROM (SELECT row_i, seq_id, cefr, tk, lb, CAST(len(tk) AS INTEGER) AS sequence_length,
             unnest(generate_series(0, least(len(tk), len(lb)) - 1)) AS feature_i
      FROM (SELECT *, string_split(token_seq, '|||') AS tk, string_split(label_seq, '|||') AS lb
            FROM o_seqs))""",
    "o_ttag": """
SELECT r.*, CASE WHEN a.word IS NOT NULL THEN a.pos WHEN b.word IS NOT NULL THEN b.pos ELSE 'X' END AS pos,
       CASE WHEN a.word IS NOT NULL THEN a.lemma WHEN b.word IS NOT NULL THEN b.lemma ELSE r.token END AS lemma
FROM o_trows r LEFT JOIN fx_lexicon a ON a.word = r.token LEFT JOIN fx_lexicon b ON b.word = lower(r.token)""",
    "o_tscal": f"""
SELECT *, CAST(length(token) AS INTEGER) AS character_length,
       trim(regexp_replace(token, {STRIP}, '', 'g'), {PUNCT}) AS stripped
FROM o_ttag""",
    "o_zipf": """
SELECT word, n, greatest(round(log10(n / sum(n) OVER ()) + 9, 2), 0.0) AS zipf
FROM (SELECT lower(stripped) AS word, count(*) AS n FROM o_tscal WHERE length(stripped) > 0 GROUP BY 1)""",
    "o_lex_psy": """
SELECT "Word" AS word, CASE "Dom_PoS_SUBTLEX" WHEN 'Noun' THEN 'NOUN' WHEN 'Verb' THEN 'VERB'
              WHEN 'Adjective' THEN 'ADJ' WHEN 'Adverb' THEN 'ADV' END AS pos,
       TRY_CAST("Freq_pm" AS DOUBLE) AS freq_pm, TRY_CAST("AoA_Kup_lem" AS DOUBLE) AS aoa
FROM fx_psy WHERE "Dom_PoS_SUBTLEX" IN ('Noun', 'Verb', 'Adjective', 'Adverb')""",
    "o_lex_cefr": """
SELECT word, CASE pos WHEN 'noun' THEN 'NOUN' WHEN 'adjective' THEN 'ADJ' WHEN 'adverb' THEN 'ADV'
                      ELSE 'VERB' END AS pos,
       CAST(CASE cefr_j WHEN 'A1' THEN 0 WHEN 'A2' THEN 1 WHEN 'B1' THEN 2 WHEN 'B2' THEN 3
                        WHEN 'C1' THEN 4 WHEN 'C2' THEN 5 END AS INTEGER) AS cefr_j
FROM fx_cefr_vocab
WHERE pos IN ('noun', 'verb', 'adjective', 'adverb', 'be-verb', 'do-verb', 'have-verb')""",
    "o_feat": f"""
SELECT t.character_length, coalesce(z.zipf, 0.0) AS frequency,
       length(t.stripped) > 0 AND regexp_matches(t.stripped, '^\\p{{Lu}}') AS first_upper,
       length(t.stripped) > 0 AND regexp_matches(t.stripped, '\\p{{Lu}}')
           AND NOT regexp_matches(t.stripped, '[\\p{{Ll}}\\p{{Lt}}]') AS all_upper,
       t.sequence_length, t.seq_id AS sequence_id, t.token, t.pos, t.cefr,
       CAST(CASE WHEN c1.word IS NOT NULL THEN c1.cefr_j ELSE c2.cefr_j END AS DOUBLE) AS cefr_j,
       CASE WHEN p1.word IS NOT NULL THEN p1.freq_pm ELSE p2.freq_pm END AS freq_pm,
       CASE WHEN p1.word IS NOT NULL THEN p1.aoa ELSE p2.aoa END AS aoa,
       t.pos = 'NOUN' AS is_noun, t.pos = 'VERB' AS is_verb, t.pos = 'ADJ' AS is_adjective,
       t.pos = 'ADV' AS is_adverb, t.label, t.row_i, t.feature_i, t.lemma, t.stripped
FROM o_tscal t
LEFT JOIN o_zipf z ON z.word = lower(t.stripped)
LEFT JOIN o_lex_psy p1 ON p1.word = t.token AND p1.pos = t.pos
LEFT JOIN o_lex_psy p2 ON p2.word = t.lemma AND p2.pos = t.pos
LEFT JOIN o_lex_cefr c1 ON c1.word = t.token AND c1.pos = t.pos
LEFT JOIN o_lex_cefr c2 ON c2.word = t.lemma AND c2.pos = t.pos""",
}


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every fixture / derived CTE it mentions."""
    all_ctes = list(FIXTURE_CTES.items()) + list(DERIVED_CTES.items())
    needed: set[str] = set()
    text = body
    # Walk backwards so that dependencies of used CTEs are found as well.
    for name, sql in reversed(all_ctes):
        if name in text:
            needed.add(name)
            text += sql
    parts = [f"{n} AS ({sql})" for n, sql in all_ctes if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


QUERIES_SQL: dict[str, str] = {}


def register(name: str, body: str) -> None:
    QUERIES_SQL[name] = with_ctes(body)


register("word_scores_e2e", """
SELECT w AS token, pos, count(*) AS n_seen, count(*) FILTER (WHERE label = 'true') AS n_true,
       count(*) FILTER (WHERE label = 'true') / count(*) AS score
FROM o_masked WHERE label IN ('true', 'false') GROUP BY w, pos
HAVING count(*) FILTER (WHERE label = 'true') > 0""")

FEATURES_19 = ("character_length, frequency, first_upper, all_upper, sequence_length, sequence_id, "
               "token, pos, cefr, cefr_j, freq_pm, aoa, is_noun, is_verb, is_adjective, is_adverb, "
               "label, row_i, feature_i")
register("features", f"SELECT {FEATURES_19} FROM o_feat")
register("feat_token", """SELECT sequence_id, feature_i, token, character_length, stripped,
       first_upper, all_upper FROM o_feat""")
register("feat_pos", """SELECT sequence_id, feature_i, pos, is_noun, is_verb, is_adjective, is_adverb
FROM o_feat""")
register("feat_psy", "SELECT sequence_id, feature_i, token, lemma, pos, freq_pm, aoa FROM o_feat")
register("feat_cefr", "SELECT sequence_id, feature_i, token, lemma, pos, cefr_j FROM o_feat")
register("feat_zipf", "SELECT sequence_id, feature_i, token, frequency FROM o_feat")
register("feat_seq_len", "SELECT DISTINCT sequence_id, sequence_length FROM o_feat")
register("token_rows", "SELECT seq_id AS sequence_id, feature_i, token, label FROM o_trows")
# Tagging needs words and lexicon only; like the sequences, words are joined and split again.
DERIVED_CTES["o_wseq"] = """
SELECT essay_id, string_split(string_agg(w, '|||' ORDER BY i), '|||') AS a FROM o_words GROUP BY essay_id"""
# Each distinct word is looked up once.
DERIVED_CTES["o_wtags"] = """
SELECT d.w, CASE WHEN a.word IS NOT NULL THEN a.pos WHEN b.word IS NOT NULL THEN b.pos ELSE 'X' END AS pos,
       CASE WHEN a.word IS NOT NULL THEN a.lemma WHEN b.word IS NOT NULL THEN b.lemma ELSE d.w END AS lemma
FROM (SELECT DISTINCT unnest(a) AS w FROM o_wseq) d
LEFT JOIN fx_lexicon a ON a.word = d.w LEFT JOIN fx_lexicon b ON b.word = lower(d.w)"""
register("tag_tokens", """
SELECT 'fx_' || CAST(l.essay_id AS VARCHAR) AS sequence_id, CAST(l.k AS INTEGER) AS feature_i, l.w AS token, t.pos, t.lemma
FROM (SELECT essay_id, unnest(range(0, len(a))) AS k, unnest(a) AS w FROM o_wseq) l JOIN o_wtags t ON t.w = l.w""")
register("zipf_table", "SELECT word, n, zipf FROM o_zipf")
register("lex_psy", "SELECT word, pos, freq_pm, aoa FROM o_lex_psy")
register("lex_cefr", "SELECT word, pos, cefr_j FROM o_lex_cefr")
register("lex_dedupe", """
SELECT lower(word) AS word, pos, max_by(cefr_j, word) AS cefr_j, max(word) AS source_word
FROM o_lex_cefr GROUP BY lower(word), pos""")
register("word_counts", """
SELECT token, pos, count(*) AS n_seen, count(*) FILTER (WHERE label = 'true') AS n_true
FROM o_feat WHERE label IN ('true', 'false') GROUP BY token, pos""")
register("word_scores", """
SELECT token, pos, count(*) AS n_seen, count(*) FILTER (WHERE label = 'true') AS n_true,
       count(*) FILTER (WHERE label = 'true') / count(*) AS score
FROM o_feat WHERE label IN ('true', 'false') GROUP BY token, pos
HAVING count(*) FILTER (WHERE label = 'true') > 0""")
register("word_scores_ordered", """
SELECT token, pos, count(*) AS n_seen, count(*) FILTER (WHERE label = 'true') AS n_true,
       count(*) FILTER (WHERE label = 'true') / count(*) AS score,
       min(row_i) AS first_row_i,
       CAST(arg_min(feature_i, row_i * 1000000 + feature_i) AS INTEGER) AS first_feature_i
FROM o_feat WHERE label IN ('true', 'false') GROUP BY token, pos
HAVING count(*) FILTER (WHERE label = 'true') > 0""")
register("seq_rows", "SELECT seq_id, token_seq, label_seq, cefr, row_i FROM o_seqs")
register("mask_labels", "SELECT essay_id, CAST(i AS BIGINT) AS i, w AS token, pos, label FROM o_masked")
register("cefr_level", "SELECT essay_id, left(cefr, 2) AS cefr FROM fx_essays")

register("norm_punct", f"SELECT essay_id, translate(text, {lit(PUNCT_FROM)}, {lit(PUNCT_TO)}) AS text FROM fx_dirty")
register("paragraphs", "SELECT essay_id, para_no, p_start, p_end, para FROM o_np_paras")
register("line_offsets", "SELECT essay_id, line_no, l_start, CAST(length(line) AS INTEGER) AS l_len FROM o_np_lines")
register("max_para_len", """
SELECT f.essay_id, CAST(max(p.p_end - p.p_start) AS INTEGER) AS max_len
FROM fx_dirty f LEFT JOIN o_rp_paras p ON p.essay_id = f.essay_id GROUP BY f.essay_id""")
register("long_essays", """
SELECT essay_id, CAST(max(p_end - p_start) AS INTEGER) AS max_len FROM o_rp_paras
GROUP BY essay_id HAVING max(p_end - p_start) > 2000""")
register("clean_para", "SELECT essay_id, para_no, clean AS para, lead FROM o_np_clean WHERE clean <> ''")
register("remap_offsets", "SELECT essay_id, para_no, o, o_clean FROM o_np_remap")
register("trim_spans", """
SELECT essay_id, para_no, o AS o_start, o_next AS o_end, s, e,
       CAST(CASE WHEN s <> e AND substring(clean, s + 1, 1) = ' ' THEN s + 1 ELSE s END AS INTEGER) AS s_trim,
       CAST(CASE WHEN s <> e AND e > 0 AND substring(clean, e, 1) = ' ' THEN e - 1 ELSE e END AS INTEGER) AS e_trim
FROM (SELECT *, o_clean AS s, lead(o_clean) OVER w AS e, lead(o) OVER w AS o_next
      FROM o_np_remap WINDOW w AS (PARTITION BY essay_id, para_no ORDER BY o))
WHERE o_next IS NOT NULL""")
register("tokenise", "SELECT essay_id, para_no, tok_i, tok, cs, ce FROM o_np_tokens")
register("para_rows", """
SELECT DISTINCT c.essay_id, c.coder, p.para_no
FROM o_ep_clean p JOIN (SELECT essay_id, coder FROM fx_coders) c ON c.essay_id = p.essay_id
WHERE p.clean <> ''""")
register("edit_kind", f"""
SELECT essay_id, coder, CAST(edit_no AS BIGINT) AS edit_no,
       CASE WHEN cor IS NULL THEN 'D' ELSE 'C' END AS kind,
       CASE WHEN cor IS NULL THEN NULL ELSE coalesce(cat, 'C') END AS cat,
       translate(cor, {lit(PUNCT_FROM)}, {lit(PUNCT_TO)}) AS cor
FROM fx_edits""")
DERIVED_CTES["o_edit_para"] = f"""
SELECT x.essay_id, x.coder, CAST(x.edit_no AS BIGINT) AS edit_no, p.para_no,
       CAST(x.s - p.p_start AS BIGINT) AS s, CAST(x.e - p.p_start AS BIGINT) AS e,
       CASE WHEN x.cor IS NULL THEN 'D' ELSE 'C' END AS kind,
       translate(x.cor, {lit(PUNCT_FROM)}, {lit(PUNCT_TO)}) AS cor
FROM fx_edits x JOIN o_ep_paras p ON p.essay_id = x.essay_id AND x.s >= p.p_start AND x.e <= p.p_end"""
register("edit_in_para", "SELECT essay_id, coder, edit_no, para_no, s, e FROM o_edit_para")
register("drop_covered_detections", """
SELECT d.essay_id, d.coder, d.para_no, d.edit_no, d.kind FROM o_edit_para d
WHERE NOT (d.kind = 'D' AND EXISTS (
    SELECT 1 FROM o_edit_para c WHERE c.essay_id = d.essay_id AND c.coder = d.coder
      AND c.para_no = d.para_no AND c.kind = 'C'
      AND ((c.s <> c.e AND c.s >= d.s AND c.e <= d.e) OR (c.s = c.e AND c.s > d.s AND c.e < d.e))))""")

DERIVED_CTES["o_ep_tokens"] = DERIVED_CTES["o_np_tokens"].replace("o_np_clean", "o_ep_clean")
DERIVED_CTES["o_kept"] = """
SELECT d.* FROM o_edit_para d
WHERE NOT (d.kind = 'D' AND EXISTS (
    SELECT 1 FROM o_edit_para c WHERE c.essay_id = d.essay_id AND c.coder = d.coder
      AND c.para_no = d.para_no AND c.kind = 'C'
      AND ((c.s <> c.e AND c.s >= d.s AND c.e <= d.e) OR (c.s = c.e AND c.s > d.s AND c.e < d.e))))"""


def _remap(o: str) -> str:
    r = (f"(length(regexp_replace(substring(c.para_ws, 1, {o}), ' +', ' ', 'g')) - CASE WHEN {o} > 0 "
         f"AND substring(c.para_ws, {o}, 1) = ' ' AND substring(c.para_ws, {o} + 1, 1) = ' ' THEN 1 ELSE 0 END)")
    return f"CAST(CASE WHEN c.lead THEN greatest({r} - 1, 0) ELSE {r} END AS INTEGER)"


DERIVED_CTES["o_ed_rm"] = f"""
SELECT k.essay_id, k.coder, k.para_no, k.edit_no, k.kind, k.cor, c.clean,
       {_remap('k.s')} AS s0, {_remap('k.e')} AS e0
FROM o_kept k JOIN o_ep_clean c ON c.essay_id = k.essay_id AND c.para_no = k.para_no
WHERE c.clean <> ''"""
DERIVED_CTES["o_ed_tr"] = """
SELECT essay_id, coder, para_no, edit_no, kind, cor, clean,
       CASE WHEN s0 <> e0 AND substring(clean, s0 + 1, 1) = ' ' THEN s0 + 1 ELSE s0 END AS s,
       CASE WHEN s0 <> e0 AND e0 > 0 AND substring(clean, e0, 1) = ' ' THEN e0 - 1 ELSE e0 END AS e
FROM o_ed_rm"""
DERIVED_CTES["o_j3_look"] = """
SELECT x.*,
  (SELECT count(*) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no) AS n,
  (SELECT min(cs) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no) AS first_cs,
  (SELECT max(cs) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no) AS last_cs,
  (SELECT max(ce) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no) AS last_ce,
  (SELECT min(tok_i) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no AND t.cs = x.s) AS ps,
  (SELECT min(tok_i) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no AND t.ce = x.e) AS pe,
  (SELECT max(cs) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no AND t.cs <= x.s) AS ls,
  (SELECT min(ce) FROM o_ep_tokens t WHERE t.essay_id = x.essay_id AND t.para_no = x.para_no AND t.ce > x.e) AS fe
FROM o_ed_tr x"""
DERIVED_CTES["o_j3_ends"] = """
SELECT *, CASE WHEN ps IS NOT NULL THEN s ELSE coalesce(ls, last_cs) END AS s2,
          CASE WHEN pe IS NOT NULL THEN e ELSE coalesce(fe, last_ce) END AS e2
FROM o_j3_look"""
DERIVED_CTES["o_j3"] = """
SELECT j.essay_id, j.coder, j.para_no, j.edit_no, j.kind, j.s, j.e, j.cor, j.clean,
  CASE WHEN j.s = j.e THEN j.ls ELSE j.s2 END AS cs2, CASE WHEN j.s = j.e THEN j.fe ELSE j.e2 END AS ce2,
  CAST(CASE WHEN j.s = j.e THEN CASE WHEN j.s = 0 OR j.s <= j.first_cs THEN 0 WHEN j.s >= j.last_ce THEN j.n
            WHEN j.ps IS NOT NULL THEN j.ps WHEN j.pe IS NOT NULL THEN j.pe + 1
            ELSE (SELECT t.tok_i FROM o_ep_tokens t WHERE t.essay_id = j.essay_id AND t.para_no = j.para_no AND t.cs = j.ls) END
       WHEN j.ps IS NOT NULL AND j.pe IS NOT NULL THEN j.ps
       ELSE (SELECT t.tok_i FROM o_ep_tokens t WHERE t.essay_id = j.essay_id AND t.para_no = j.para_no AND t.cs = j.s2) END AS INTEGER) AS ts,
  CAST(CASE WHEN j.s = j.e THEN CASE WHEN j.s = 0 OR j.s <= j.first_cs THEN 0 WHEN j.s >= j.last_ce THEN j.n
            WHEN j.ps IS NOT NULL THEN j.ps WHEN j.pe IS NOT NULL THEN j.pe + 1
            ELSE (SELECT t.tok_i + 1 FROM o_ep_tokens t WHERE t.essay_id = j.essay_id AND t.para_no = j.para_no AND t.ce = j.fe) END
       WHEN j.ps IS NOT NULL AND j.pe IS NOT NULL THEN j.pe + 1
       ELSE (SELECT t.tok_i + 1 FROM o_ep_tokens t WHERE t.essay_id = j.essay_id AND t.para_no = j.para_no AND t.ce = j.e2) END AS INTEGER) AS te,
  CASE WHEN j.s = j.e THEN NOT (j.s = 0 OR j.s <= j.first_cs OR j.s >= j.last_ce OR j.ps IS NOT NULL OR j.pe IS NOT NULL)
       ELSE NOT (j.ps IS NOT NULL AND j.pe IS NOT NULL) END AS expanded
FROM o_j3_ends j"""
register("char_to_tok", """
SELECT essay_id, coder, para_no, CAST(edit_no AS BIGINT) AS edit_no, kind, CAST(s AS INTEGER) AS s,
       CAST(e AS INTEGER) AS e, ts, te, expanded FROM o_j3""")
register("fmt_edit", """
SELECT essay_id, coder, CAST(edit_no AS BIGINT) AS edit_no,
       'A ' || CAST(s AS VARCHAR) || ' ' || CAST(e AS VARCHAR) || '|||' || coalesce(cat, 'D') || '|||' ||
       array_to_string(list_filter(regexp_split_to_array(coalesce(cor, ''), ' +'), lambda t: t <> ''), ' ')
       || '|||REQUIRED|||-NONE-|||' || CAST(coder AS VARCHAR) AS line
FROM fx_edits""")
register("parse_edit", """
SELECT essay_id, coder, CAST(edit_no AS BIGINT) AS edit_no, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end",
       coalesce(cat, 'D') AS cat,
       array_to_string(list_filter(regexp_split_to_array(coalesce(cor, ''), ' +'), lambda t: t <> ''), ' ') AS cor,
       CAST(coder AS VARCHAR) AS coder_field
FROM fx_edits""")
register("parse_sent", f"""
SELECT essay_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT essay_id, list_filter(regexp_split_to_array(regexp_replace(text, {STRIP}, '', 'g'), {lit(PY_WS + '+')}),
                                   lambda t: t <> '') AS toks FROM fx_essays)""")
register("edits_by_coder", """
SELECT essay_id, coder, count(*) AS n_edits, string_agg(CAST(edit_no AS VARCHAR), ',' ORDER BY edit_no) AS edit_nos
FROM fx_edits GROUP BY essay_id, coder""")
register("coder0_sents", """
SELECT t.essay_id, t.para_no, 'S ' || string_agg(t.tok, ' ' ORDER BY t.tok_i) AS s_line
FROM o_ep_tokens t GROUP BY t.essay_id, t.para_no""")
register("coder_align", """
SELECT p.essay_id, p.para_no, c.coder
FROM (SELECT DISTINCT essay_id, para_no FROM o_ep_tokens) p
JOIN (SELECT essay_id, coder FROM fx_coders) c ON c.essay_id = p.essay_id""")

DERIVED_CTES["o_w4"] = """
SELECT essay_id, coder, para_no,
  list_reduce(list(struct_pack(n := CAST(edit_no AS BIGINT), ts := ts, te := te, xp := expanded) ORDER BY edit_no),
    lambda acc, y: CASE WHEN y.xp AND y.ts < acc.prev
                        THEN struct_pack(prev := acc.prev, dropped := list_append(acc.dropped, y.n))
                        ELSE struct_pack(prev := y.te, dropped := acc.dropped) END,
    struct_pack(prev := CAST(0 AS INTEGER), dropped := CAST([] AS BIGINT[]))).dropped AS dropped
FROM o_j3 GROUP BY essay_id, coder, para_no"""
DERIVED_CTES["o_cor"] = f"""
SELECT j.*, w.dropped IS NOT NULL AND list_contains(w.dropped, CAST(j.edit_no AS BIGINT)) AS is_dropped,
       CASE WHEN j.expanded THEN regexp_replace(
              CASE WHEN j.s > j.cs2 THEN substring(j.clean, j.cs2 + 1, j.s - j.cs2) ELSE '' END || j.bt ||
              CASE WHEN j.ce2 > j.e THEN substring(j.clean, j.e + 1, j.ce2 - j.e) ELSE '' END, {STRIP}, '', 'g')
            ELSE j.bt END AS full_text
FROM (SELECT *, coalesce(cor, CASE WHEN e > s THEN substring(clean, s + 1, e - s) ELSE '' END) AS bt FROM o_j3) j
LEFT JOIN o_w4 w ON w.essay_id = j.essay_id AND w.coder = j.coder AND w.para_no = j.para_no"""
DERIVED_CTES["o_ncor"] = f"""
SELECT *, CAST(CASE WHEN kind = 'D' THEN greatest(te - greatest(ts, 0), 0)
            ELSE len(regexp_extract_all(regexp_replace(full_text, {STRIP}, '', 'g'), {lit(TOKEN_RE)})) END
          AS INTEGER) AS ncor
FROM o_cor WHERE NOT is_dropped"""
DERIVED_CTES["o_cspans"] = """
SELECT *, CAST(ts + coalesce(sum(ncor - (te - ts)) OVER (PARTITION BY essay_id, coder, para_no ORDER BY edit_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS c_start
FROM o_ncor"""
register("edit_order", """
SELECT essay_id, coder, para_no, CAST(edit_no AS BIGINT) AS edit_no, m2_rank FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY essay_id, coder, para_no ORDER BY te, ts, edit_no) - 1 AS INTEGER) AS m2_rank FROM o_ncor)
WHERE kind = 'D' OR ts <> te OR ncor > 0""")
register("drop_overlaps", "SELECT essay_id, coder, para_no, unnest(dropped) AS edit_no FROM o_w4")
register("fill_detection", """
SELECT c.essay_id, c.coder, c.para_no, CAST(c.edit_no AS BIGINT) AS edit_no, c.ts, c.te,
       coalesce((SELECT string_agg(t.tok, ' ' ORDER BY t.tok_i) FROM o_ep_tokens t
                 WHERE t.essay_id = c.essay_id AND t.para_no = c.para_no AND t.tok_i >= c.ts AND t.tok_i < c.te), '') AS cor
FROM o_ncor c WHERE c.kind = 'D'""")
register("expand_cor", """
SELECT essay_id, coder, para_no, CAST(edit_no AS BIGINT) AS edit_no, full_text AS cor_text
FROM o_ncor WHERE expanded""")
register("cor_spans", """
SELECT essay_id, coder, para_no, CAST(edit_no AS BIGINT) AS edit_no, ts, te, c_start,
       CAST(c_start + ncor AS INTEGER) AS c_end FROM o_cspans""")

DERIVED_CTES["o_split"] = """
SELECT seq_id, CASE WHEN row_number() OVER (ORDER BY md5('1848_' || seq_id)) <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ())
            THEN 'test' ELSE 'train' END AS split
FROM o_seqs"""
register("split_rows", "SELECT seq_id, split FROM o_split")
register("split_dev", """
SELECT seq_id, split FROM o_split WHERE split = 'test'
UNION ALL
SELECT seq_id, CASE WHEN row_number() OVER (ORDER BY md5('1848_dev' || seq_id)) <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ())
                    THEN 'dev' ELSE 'train' END AS split
FROM o_split WHERE split = 'train'""")
register("split_grouped", """
SELECT CAST(e.essay_id AS VARCHAR) AS seq_id, e.cefr, v.split FROM fx_essays e JOIN
  (SELECT cefr, CASE WHEN row_number() OVER (ORDER BY md5('1848_' || cefr)) <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ())
                     THEN 'test' ELSE 'train' END AS split
   FROM (SELECT DISTINCT cefr FROM fx_essays)) v ON v.cefr = e.cefr""")
register("src_tsv", "SELECT seq_id, token_seq, label_seq, cefr, row_i FROM o_seqs")

register("combine", """
SELECT q.seq_id, q.token_seq, q.label_seq, CASE WHEN p.split = 'test' THEN NULL ELSE q.cefr END AS cefr, q.row_i
FROM o_seqs q JOIN o_split p ON p.seq_id = q.seq_id""")

DERIVED_CTES["o_ops"] = """
SELECT essay_id, coder, para_no, op, p, r, n2, kk FROM (
  SELECT essay_id, coder, para_no, ts AS p, 0 AS r, edit_no AS n2, k AS kk,
         CASE WHEN k < least(te - ts, ncor) THEN 'S' WHEN te - ts > ncor THEN 'D' ELSE 'I' END AS op
  FROM (SELECT *, unnest(generate_series(0, greatest(te - ts, ncor) - 1)) AS k FROM o_cspans
        WHERE greatest(te - ts, ncor) > 0)
  UNION ALL
  SELECT c.essay_id, c.coder, t.para_no, t.tok_i AS p, 1 AS r, 0 AS n2, 0 AS kk, 'M' AS op
  FROM o_ep_tokens t JOIN (SELECT essay_id, coder FROM fx_coders) c ON c.essay_id = t.essay_id
  WHERE NOT EXISTS (SELECT 1 FROM o_cspans x WHERE x.essay_id = t.essay_id AND x.coder = c.coder
                    AND x.para_no = t.para_no AND t.tok_i >= x.ts AND t.tok_i < x.te))"""
DERIVED_CTES["o_ops2"] = """
SELECT *, coalesce(sum(CASE WHEN op = 'I' THEN 0 ELSE 1 END) OVER wb, 0) AS o_pos,
          coalesce(sum(CASE WHEN op = 'D' THEN 0 ELSE 1 END) OVER wb, 0) AS c_pos,
          sum(CASE WHEN op = 'M' THEN 1 ELSE 0 END) OVER wc AS g_merge,
          sum(CASE WHEN lg IS NOT DISTINCT FROM op THEN 0 ELSE 1 END) OVER wc AS g_equal,
          row_number() OVER w0 AS g_split
FROM (SELECT *, lag(op) OVER w0 AS lg FROM o_ops WINDOW w0 AS (PARTITION BY essay_id, coder, para_no ORDER BY p, r, n2, kk))
WINDOW w0 AS (PARTITION BY essay_id, coder, para_no ORDER BY p, r, n2, kk),
       wb AS (PARTITION BY essay_id, coder, para_no ORDER BY p, r, n2, kk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       wc AS (PARTITION BY essay_id, coder, para_no ORDER BY p, r, n2, kk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
register("merge_ops", """
SELECT essay_id, coder, para_no, strategy, CAST(min(o_pos) AS BIGINT) AS o_start,
       CAST(max(o_pos + CASE WHEN op = 'I' THEN 0 ELSE 1 END) AS BIGINT) AS o_end,
       CAST(min(c_pos) AS BIGINT) AS c_start, CAST(max(c_pos + CASE WHEN op = 'D' THEN 0 ELSE 1 END) AS BIGINT) AS c_end,
       string_agg(op, '' ORDER BY p, r, n2, kk) AS ops
FROM (SELECT *, unnest(['all-split', 'all-merge', 'all-equal']) AS strategy FROM o_ops2 WHERE op <> 'M')
GROUP BY essay_id, coder, para_no, strategy,
         CASE strategy WHEN 'all-split' THEN g_split WHEN 'all-merge' THEN g_merge ELSE g_equal END""")


# ---------------------------------------------------------------- M2 chain
DERIVED_CTES["o_ptoks"] = """
SELECT essay_id, para_no, list(tok ORDER BY tok_i) AS toks FROM o_ep_tokens GROUP BY essay_id, para_no"""
DERIVED_CTES["o_ctoks"] = f"""
SELECT s.*, p.toks, CASE WHEN s.kind = 'D' THEN p.toks[greatest(s.ts, 0) + 1 : s.te]
       ELSE regexp_extract_all(regexp_replace(s.full_text, {STRIP}, '', 'g'), {lit(TOKEN_RE)}) END AS ct
FROM o_cspans s JOIN o_ptoks p ON p.essay_id = s.essay_id AND p.para_no = s.para_no"""


def _bound(v: str, n: str) -> str:
    """A slice bound as Python takes it: from the end if negative, within 0..n."""
    return f"least(greatest(CASE WHEN {v} < 0 THEN {v} + {n} ELSE {v} END, 0), {n})"


def _splice(start: str, end: str, new: str) -> str:
    """The fold's sentence with [start, end) replaced by ``new``."""
    a = _bound(f"({start} + acc.off)", "len(acc.cor)")
    b = f"greatest({_bound(f'({end} + acc.off)', 'len(acc.cor)')}, {a})"
    return f"acc.cor[1:{a}] || {new} || acc.cor[{b} + 1:len(acc.cor)]", f"acc.cor[{a} + 1:{b}]"


_APPLIED, _ = _splice("y.ts", "y.te", "y.ct")
DERIVED_CTES["o_applied"] = f"""
SELECT c.essay_id, c.coder, p.para_no, p.toks, coalesce(f.cor, p.toks) AS cor
FROM o_ptoks p JOIN fx_coders c ON c.essay_id = p.essay_id LEFT JOIN (
  SELECT essay_id, coder, para_no, list_reduce(list(struct_pack(ts := ts, te := te, ct := ct) ORDER BY edit_no),
    lambda acc, y: struct_pack(off := CAST(acc.off - (y.te - y.ts) + len(y.ct) AS INTEGER), cor := {_APPLIED}),
    struct_pack(off := CAST(0 AS INTEGER), cor := any_value(toks))).cor AS cor
  FROM o_ctoks GROUP BY essay_id, coder, para_no) f
ON f.essay_id = c.essay_id AND f.coder = c.coder AND f.para_no = p.para_no"""
DERIVED_CTES["o_sides"] = """
SELECT *, CASE WHEN kind = 'D' THEN 0 ELSE coalesce(list_min(list_filter(range(1, m + 1), lambda k: o0[k] IS DISTINCT FROM c0[k])) - 1, m) END AS pre
FROM (SELECT *, least(len(o0), len(c0)) AS m FROM (
  SELECT t.essay_id, t.coder, t.para_no, t.edit_no, t.kind, t.ts, t.te, t.c_start, CAST(t.c_start + t.ncor AS INTEGER) AS c_end,
         CAST(row_number() OVER (PARTITION BY t.essay_id, t.coder, t.para_no ORDER BY t.te, t.ts, t.edit_no) - 1 AS INTEGER) AS rank,
         t.toks[greatest(t.ts, 0) + 1 : t.te] AS o0, a.cor[greatest(t.c_start, 0) + 1 : t.c_start + t.ncor] AS c0
  FROM o_ctoks t JOIN o_applied a ON a.essay_id = t.essay_id AND a.coder = t.coder AND a.para_no = t.para_no))"""
DERIVED_CTES["o_sides2"] = """
SELECT *, CASE WHEN kind = 'D' THEN 0 ELSE coalesce(list_min(list_filter(range(1, m - pre + 1),
            lambda k: o0[len(o0) - k + 1] IS DISTINCT FROM c0[len(c0) - k + 1])) - 1, m - pre) END AS suf
FROM o_sides"""
DERIVED_CTES["o_lines"] = """
SELECT * FROM (
  SELECT essay_id, coder, para_no, CAST(edit_no AS BIGINT) AS edit_no, kind, rank, CAST(ts + pre AS INTEGER) AS o_start,
         CAST(te - suf AS INTEGER) AS o_end, CAST(c_start + pre AS INTEGER) AS c_start, CAST(c_end - suf AS INTEGER) AS c_end,
         o0[pre + 1 : len(o0) - suf] AS o_toks, c0[pre + 1 : len(c0) - suf] AS c_toks FROM o_sides2)
WHERE kind = 'D' OR o_start <> o_end OR len(c_toks) > 0"""
DERIVED_CTES["o_linetags"] = """
SELECT l.essay_id, l.coder, l.para_no, l.rank, count(DISTINCT coalesce(a.pos, b.pos, 'X')) AS n, min(coalesce(a.pos, b.pos, 'X')) AS pos
FROM (SELECT essay_id, coder, para_no, rank, unnest(o_toks || c_toks) AS tok FROM o_lines) l
LEFT JOIN fx_lexicon a ON a.word = l.tok LEFT JOIN fx_lexicon b ON b.word = lower(l.tok)
GROUP BY l.essay_id, l.coder, l.para_no, l.rank"""
DERIVED_CTES["o_typed"] = """
SELECT l.*, CASE WHEN array_to_string(o_toks, ' ') = array_to_string(c_toks, ' ') THEN 'UNK'
                 WHEN len(o_toks) = 0 THEN 'M:' || g WHEN len(c_toks) = 0 THEN 'U:' || g ELSE 'R:' || g END AS type
FROM (SELECT l.*, CASE WHEN t.n = 1 AND t.pos <> 'X' THEN t.pos ELSE 'OTHER' END AS g FROM o_lines l
      LEFT JOIN o_linetags t ON t.essay_id = l.essay_id AND t.coder = l.coder AND t.para_no = l.para_no AND t.rank = l.rank) l"""
DERIVED_CTES["o_alines"] = """
SELECT a.essay_id, a.para_no, a.coder, coalesce(t.rank, 0) AS rank, coalesce(t.o_start, -1) AS s, coalesce(t.o_end, -1) AS e,
       coalesce(t.type, 'noop') AS cat, CASE WHEN t.rank IS NULL THEN ['-NONE-'] ELSE t.c_toks END AS cor
FROM o_applied a LEFT JOIN o_typed t ON t.essay_id = a.essay_id AND t.coder = a.coder AND t.para_no = a.para_no"""


def _a_line(s: str, e: str, cat: str, cor: str, coder: str) -> str:
    return (f"'A ' || CAST({s} AS VARCHAR) || ' ' || CAST({e} AS VARCHAR) || '|||' || {cat} || '|||' || "
            f"array_to_string({cor}, ' ') || '|||REQUIRED|||-NONE-|||' || CAST({coder} AS VARCHAR)")


_INVERTED, _REPLACED = _splice("y.s", "y.e", "y.cor")
DERIVED_CTES["o_inverted"] = f"""
SELECT essay_id, para_no, r.cor AS toks, r.out AS out FROM (
  SELECT b.essay_id, b.para_no, list_reduce(list(struct_pack(s := b.s, e := b.e, cat := b.cat, cor := b.cor, coder := b.coder)
                                                 ORDER BY b.coder, b.rank),
    lambda acc, y: CASE WHEN y.cat = 'noop' THEN struct_pack(off := acc.off, cor := acc.cor, out := list_append(acc.out,
        struct_pack(s := CAST(-1 AS INTEGER), e := CAST(-1 AS INTEGER), cat := y.cat, txt := ['-NONE-'], coder := y.coder)))
      ELSE struct_pack(off := CAST(acc.off - (y.e - y.s) + len(y.cor) AS INTEGER), cor := {_INVERTED}, out := list_append(acc.out,
        struct_pack(s := CAST(y.s + acc.off AS INTEGER), e := CAST(y.s + acc.off + len(y.cor) AS INTEGER), cat := y.cat,
                    txt := {_REPLACED}, coder := y.coder))) END,
    struct_pack(off := CAST(0 AS INTEGER), cor := any_value(p.toks),
                out := CAST([] AS STRUCT(s INTEGER, e INTEGER, cat VARCHAR, txt VARCHAR[], coder INTEGER)[]))) AS r
  FROM o_alines b JOIN o_ptoks p ON p.essay_id = b.essay_id AND p.para_no = b.para_no GROUP BY b.essay_id, b.para_no)"""
DERIVED_CTES["o_invlab"] = f"""
SELECT essay_id, para_no, toks, list_transform(range(0, len(toks)), lambda i:
         CASE WHEN len(list_filter(out, lambda x: x.cat IN {SELECTED} AND x.s <= i AND i < x.e)) > 0 THEN 'true' ELSE 'false' END) AS labels
FROM o_inverted"""
DERIVED_CTES["o_dataset"] = f"""
SELECT l.essay_id, l.para_no, string_agg(l.tok, '|||' ORDER BY l.i) AS token_seq,
       string_agg(CASE WHEN coalesce(a.pos, b.pos, 'X') IN {CONTENT} THEN l.label ELSE 'NONE' END, '|||' ORDER BY l.i) AS label_seq
FROM (SELECT essay_id, para_no, unnest(range(0, len(toks))) AS i, unnest(toks) AS tok, unnest(labels) AS label FROM o_invlab) l
LEFT JOIN fx_lexicon a ON a.word = l.tok LEFT JOIN fx_lexicon b ON b.word = lower(l.tok)
GROUP BY l.essay_id, l.para_no"""

register("apply_edits", """
SELECT essay_id, coder, para_no, array_to_string(toks, ' ') AS orig, array_to_string(cor, ' ') AS cor FROM o_applied""")
register("apply_counts", """
SELECT a.essay_id, a.coder, a.para_no, CAST(len(a.toks) AS INTEGER) AS n_orig, CAST(len(a.cor) AS INTEGER) AS n_cor,
       CAST(coalesce((SELECT sum(len(t.ct) - (t.te - t.ts)) FROM o_ctoks t WHERE t.essay_id = a.essay_id AND t.coder = a.coder
                      AND t.para_no = a.para_no), 0) AS INTEGER) AS delta
FROM o_applied a""")
register("minimise", """
SELECT essay_id, para_no, coder, rank, edit_no, kind, o_start, o_end, c_start, c_end,
       array_to_string(o_toks, ' ') AS o_str, array_to_string(c_toks, ' ') AS c_str FROM o_lines""")
register("classify_edits", "SELECT essay_id, para_no, coder, rank, edit_no, type FROM o_typed")
register("noop_rows", "SELECT essay_id, para_no, CAST(coder AS VARCHAR) AS coder FROM o_alines WHERE cat = 'noop'")
DERIVED_CTES["o_blocktext"] = f"""
SELECT b.essay_id, b.para_no, 'S ' || array_to_string(any_value(p.toks), ' ') || chr(10) ||
       string_agg({_a_line('b.s', 'b.e', 'b.cat', 'b.cor', 'b.coder')}, chr(10) ORDER BY b.coder, b.rank) AS value
FROM o_alines b JOIN o_ptoks p ON p.essay_id = b.essay_id AND p.para_no = b.para_no GROUP BY b.essay_id, b.para_no"""
register("m2_text", "SELECT essay_id, para_no, value FROM o_blocktext")
register("invert", f"""
SELECT essay_id, para_no, CASE WHEN len(toks) = 0 THEN 'S' || ' ' ELSE 'S ' || array_to_string(toks, ' ') END || chr(10) ||
       array_to_string(list_transform(out, lambda x: {_a_line('x.s', 'x.e', 'x.cat', 'x.txt', 'x.coder')}), chr(10)) AS value
FROM o_inverted""")
register("label_tokens", """
SELECT essay_id, para_no, array_to_string(toks, '|||') AS token_seq, array_to_string(labels, '|||') AS label_seq FROM o_invlab""")
register("dataset_e2e", """
SELECT d.essay_id, d.para_no, CAST(d.essay_id AS VARCHAR) || '_' || CAST(d.para_no AS VARCHAR) AS seq_id,
       d.token_seq, d.label_seq, left(e.cefr, 2) AS cefr
FROM o_dataset d JOIN fx_essays e ON e.essay_id = d.essay_id""")

DERIVED_CTES["o_files"] = """
SELECT t.*, 'g' || CAST(t.essay_id // 256 AS VARCHAR) AS file,
       CAST(row_number() OVER (PARTITION BY t.essay_id // 256 ORDER BY t.essay_id, t.para_no) - 1 AS INTEGER) AS block_no
FROM o_ptoks t"""
register("src_essays", """
SELECT 'g' || CAST(c.essay_id // 256 AS VARCHAR) AS file, l.line_no, c.coder, e.edit_no, e.s, e.e, e.cor, e.cat
FROM fx_coders c JOIN (SELECT essay_id, CAST(row_number() OVER (PARTITION BY essay_id // 256 ORDER BY essay_id) - 1 AS INTEGER) AS line_no
                       FROM fx_essays) l ON l.essay_id = c.essay_id
LEFT JOIN (SELECT essay_id, coder, row_number() OVER (PARTITION BY essay_id, coder ORDER BY edit_no) - 1 AS edit_no,
                  CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, cor, cat FROM fx_edits) e
  ON e.essay_id = c.essay_id AND e.coder = c.coder""")
register("src_glob", """
SELECT 'g' || CAST(essay_id // 256 AS VARCHAR) AS file, count(*) AS n_essays FROM fx_essays GROUP BY 1""")
register("snk_m2", "SELECT 'g' || CAST(essay_id // 256 AS VARCHAR) AS file, value FROM o_blocktext")
register("src_m2", """
SELECT f.file, f.block_no, array_to_string(f.toks, ' ') AS tokens, CAST(count(*) AS INTEGER) AS n_edits
FROM o_files f JOIN o_alines a ON a.essay_id = f.essay_id AND a.para_no = f.para_no GROUP BY f.file, f.block_no, f.toks""")
register("block_no", """
SELECT f.file, f.block_no, len(i.toks) > 0 AS kept FROM o_files f
JOIN o_inverted i ON i.essay_id = f.essay_id AND i.para_no = f.para_no""")
register("cefr_attach", """
SELECT f.file, f.block_no, array_to_string(f.toks, ' ') AS tokens, left(e.cefr, 2) AS cefr
FROM o_files f JOIN fx_essays e ON e.essay_id = f.essay_id""")
register("dataset_files", """
SELECT f.file || '_' || CAST(f.block_no AS VARCHAR) AS seq_id, d.token_seq, d.label_seq, left(e.cefr, 2) AS cefr
FROM o_files f JOIN o_dataset d ON d.essay_id = f.essay_id AND d.para_no = f.para_no JOIN fx_essays e ON e.essay_id = f.essay_id""")


def _cell(c: str) -> str:
    """Minimal quoting: a cell that holds a quote, a tab or a line end."""
    return f"""CASE WHEN regexp_matches({c}, '["\\t\\n\\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


register("snk_tsv", f"""
SELECT {_cell('seq_id')} || chr(9) || {_cell('token_seq')} || chr(9) || {_cell('label_seq')} || chr(9) || {_cell('cefr')}
       || chr(9) || CAST(row_i AS VARCHAR) AS value FROM o_seqs""")
register("src_tsv_nohdr", """
SELECT seq_id AS "0", token_seq AS "1", label_seq AS "2", cefr AS "3", CAST(row_i AS VARCHAR) AS "4" FROM o_seqs""")
register("snk_scores", """
SELECT token || '|||' || pos AS key, count(*) FILTER (WHERE label = 'true') / count(*) AS score
FROM o_feat WHERE label IN ('true', 'false') GROUP BY token, pos
HAVING count(*) FILTER (WHERE label = 'true') > 0""")
register("stream_features", f"SELECT {FEATURES_19} FROM o_feat")

# ---------------------------------------------------------------- stream, numbering, reports
DERIVED_CTES.update(paragraph_ctes("fx_essays", "o_fp"))
_SCORES = """
SELECT token, pos, count(*) AS n_seen, count(*) FILTER (WHERE label = 'true') AS n_true,
       count(*) FILTER (WHERE label = 'true') / count(*) AS score
FROM o_ttag WHERE label IN ('true', 'false') GROUP BY token, pos
HAVING count(*) FILTER (WHERE label = 'true') > 0"""
register("stream_word_scores", _SCORES)
register("word_scores_files", _SCORES)
register("dense_rows", """
SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS row_i
FROM (SELECT DISTINCT 'fx_' || CAST(essay_id AS VARCHAR) AS seq_id FROM o_words)""")
register("lost_counts", """
SELECT 'edits' AS what, count(*) AS n FROM fx_edits
UNION ALL SELECT 'crossing', (SELECT count(*) FROM fx_edits) - (SELECT count(*) FROM (SELECT DISTINCT essay_id, coder, edit_no FROM o_edit_para))
UNION ALL SELECT 'paragraphs', count(*) FROM o_ptoks
UNION ALL SELECT 'without_coder_0', count(*) FROM o_ptoks WHERE essay_id % 20 = 0""")
register("long_essay_report", """
SELECT 'g' || CAST(l.essay_id // 256 AS VARCHAR) AS file, l.line_no, p.max_len
FROM (SELECT essay_id, CAST(row_number() OVER (PARTITION BY essay_id // 256 ORDER BY essay_id) - 1 AS INTEGER) AS line_no FROM fx_essays) l
JOIN (SELECT essay_id, CAST(max(p_end - p_start) AS INTEGER) AS max_len FROM o_fp_paras
      GROUP BY essay_id HAVING max(p_end - p_start) > 1000) p ON p.essay_id = l.essay_id""")
