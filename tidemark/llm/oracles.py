"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import MAX_REPEATED_PERCENT, MIN_WORDS, UNSPACED

#: White space that parts words, as a character class.
GAP = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda w: w <> '')"

_tails = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]"
_escaped = rf"regexp_replace({{}}, '([<\[])(\\*)({_tails})', '\1\2\\\3', 'g')"
_role = _escaped.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")

OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({_role}) + length({_escaped.format('text')}) + length('<|im_start|>') + length('<|im_end|>') + 2) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM joined
"""

OP5 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hits),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

UNSPACED_CLASS = "".join(rf"\p{{{s}}}" for s in UNSPACED)

OP9 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM again) GROUP BY 1),
base AS (
  SELECT doc_id, text, words, len(lines) AS n_lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (doc_id)
), judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (word_chars > 20 * n_words AND 2 * length(regexp_replace(text, '[^{UNSPACED_CLASS}]', '', 'g')) < word_chars) OR word_chars < 2 * n_words OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
    OR 2 * length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g')) < word_chars OR (n_words >= 50 AND 20 * len(list_distinct(words)) < n_words)) AS kept
FROM judged
"""

ORACLES = {"op4_chat_format": OP4, "op5_substring_dedup": OP5, "op9_quality_rules": OP9}
