"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _permuted(key: str, salt: str) -> str:
    """mixing.permuted for ids below 2 ** 31."""
    x = f"(({key} + {salt} * 40503) & 2147483647)"
    for multiplier, shift in ((1103515245, 15), (739982445, 12), (695872825, 15)):
        x = f"list_transform([{x} * {multiplier} & 2147483647], lambda v: xor(v, v >> {shift}))[1]"
    return x


MIXING = rf"""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens, {_permuted("doc_id", "0")} AS perm FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM t GROUP BY source), tot AS (SELECT sum(tokens)::DOUBLE AS total FROM s),
sh AS (SELECT tokens / total AS p FROM s, tot WHERE tokens > 0), n AS (SELECT count(*) AS n FROM sh),
u AS (SELECT g.range AS g, p, pow(p, g.range / 4096) AS u FROM sh, range(0, 4097) g),
a AS (SELECT g, ln(sum(u)) - sum(u * ln(u)) / sum(u) AS entropy FROM u GROUP BY g),
e AS (SELECT CASE WHEN (SELECT n FROM n) < 2 THEN 4096 ELSE coalesce((SELECT max(g) FROM a WHERE entropy >= 0.995 * ln((SELECT n FROM n))), 0) END AS g),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, (SELECT g FROM e) / 4096) ELSE 0 END AS u FROM s, tot),
z AS (SELECT sum(u) AS z, (sum(tokens) * 150 // 100)::BIGINT AS budget FROM w),
q AS (SELECT source, tokens, u / z AS weight, round(u * (budget / z))::BIGINT AS quota FROM w, z),
r AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM q),
c AS (SELECT t.doc_id, t.source, perm, weight, quota, r.tokens AS total, passes, CASE WHEN rest > 0 AND sum(t.tokens) OVER (PARTITION BY t.source ORDER BY perm) <= rest THEN 1 ELSE 0 END AS more FROM t JOIN r ON t.source = r.source),
b AS (SELECT greatest(1, ceil(sum(quota) / 1048576))::BIGINT AS blocks FROM q),
x AS (SELECT c.*, unnest(range(0, passes + more)) AS mix_epoch FROM c WHERE passes + more > 0)
SELECT doc_id, source, mix_epoch, least(floor((mix_epoch + perm / 2147483648) * total / greatest(quota, 1) * blocks), blocks - 1)::BIGINT AS mix_block,
  {_permuted("doc_id", "(mix_epoch + 1)")} AS mix_order, (SELECT g FROM e)::INT AS exponent, round(weight, 9) AS weight, quota FROM x, b"""

TOP_K = """WITH v AS (SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, array_to_string(words[i:i + 4], chr(32)) AS gram FROM g),
p AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(i - prev, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM p) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!!')) AS n_shouts, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
  + 16 * (100 * n_shouts > 10 * n_words)::BIGINT + 32 * (100 * n_upper > 50 * word_chars)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT + 128 * (word_chars > 20 * n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f"""

_CONTROL = r"\\|</?s>|\[/?INST\]|<\|endoftext\|>"

CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, len(role) + len(text) + 20 + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM n GROUP BY conv_id"""
