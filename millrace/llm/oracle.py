"""SQL for the queries that SQL can express, over the same tables. The others are tested against brute force."""

from __future__ import annotations

from . import mixing, quality_rules, sharding

WORD = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
PLAIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
    WITH RECURSIVE table8(i, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM table8 WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM table8 WHERE k = 8),
    sized AS (SELECT doc_id, source, text, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{sharding.SEED}:' || md5(coalesce(text, ''))) AS mix FROM documents),
    summed AS (SELECT doc_id, source, size, mix, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)::BIGINT AS text_crc32 FROM sized, crc),
    ranked AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY mix, doc_id, size, text_crc32) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS share FROM summed),
    placed AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS LAST, mix, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM ranked),
    dealt AS (SELECT *, (pos * 40 // total)::INTEGER AS shard FROM placed)
    SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt"""

OP2 = f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(plain) AS text_sha256
    FROM (SELECT doc_id, {PLAIN} AS plain FROM documents) WINDOW same AS (PARTITION BY plain)"""

OP3 = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    covered AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM covered, range(20) t(k)),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

TICKET = "('0x' || substr(md5({}), 1, 13))::BIGINT"
OTHER = "((k % full_blocks - x) % full_blocks + full_blocks) % full_blocks"
HIGHER = f"(greatest(x, {OTHER}) + k) % {mixing.PRIME}"
SQUARED = f"(({HIGHER}) * ({HIGHER}) + k % {mixing.PRIME}) % {mixing.PRIME}"
HASH = f"(({SQUARED}) * ({SQUARED})) % {mixing.PRIME}"
KEY = TICKET.format(f"'{mixing.SEED}:' || coalesce(source, '') || ':' || pass || ':' || i")
OP5 = f"""
    WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}:' || md5(coalesce(text, ''))) AS mix FROM documents),
    placed AS (SELECT *, row_number() OVER () AS row_id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
    levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank
        FROM weighted WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    plan AS (SELECT source, source_size, least(cap, (SELECT level FROM levels WHERE level * w <= cap ORDER BY rank LIMIT 1) * w) AS target FROM levels),
    aims AS (SELECT *, round(target)::BIGINT AS goal, source_size // {mixing.BLOCK} AS full_blocks, (source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks FROM plan WHERE source_size > 0 AND round(target) > 0),
    wants AS (SELECT *, goal // source_size * blocks + (goal % source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS wanted FROM aims),
    goals AS (SELECT *, (sum(wanted) OVER (ORDER BY source NULLS LAST) - wanted)::BIGINT AS first FROM wants),
    tickets AS (SELECT (id % {mixing.SHARDS})::INTEGER AS shard, {TICKET.format(f"id::VARCHAR || ':{mixing.SEED}'")} % (SELECT sum(wanted) FROM goals)::BIGINT AS ticket FROM (SELECT unnest(range((SELECT sum(wanted) FROM goals)::BIGINT)) AS id)),
    draws AS (SELECT source, shard, count(*) AS n FROM tickets JOIN goals ON ticket >= first AND ticket < first + wanted GROUP BY source, shard),
    ranks AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY shard) - n)::BIGINT AS rank FROM draws),
    drawn AS (SELECT g.*, coalesce(a, 0)::BIGINT AS every FROM goals g LEFT JOIN (SELECT source, sum(n) AS a FROM draws GROUP BY source) x ON g.source IS NOT DISTINCT FROM x.source),
    sides AS (SELECT *, greatest(every - wanted, 0) AS over_n, greatest(wanted - every, 0) AS short_n FROM drawn),
    ends AS (SELECT *, (sum(over_n) OVER (ORDER BY source NULLS LAST) - over_n)::BIGINT AS over_at, (sum(short_n) OVER (ORDER BY source NULLS LAST) - short_n)::BIGINT AS short_at FROM sides),
    singles AS (SELECT source, shard, rank + j AS rank FROM (SELECT source, shard, rank, unnest(range(n)) AS j FROM ranks)),
    spread AS (SELECT e.source, shard, rank, (rank * over_n) // every AS gone, ((rank + 1) * over_n) // every AS gone_next, over_at FROM singles r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source),
    freed AS (SELECT over_at + gone AS turn, shard FROM spread WHERE gone < gone_next),
    filled AS (SELECT source, every + j AS number, short_at + j AS turn FROM (SELECT *, unnest(range(short_n)) AS j FROM ends)),
    numbered AS (SELECT source, rank - gone AS number, shard FROM spread WHERE gone = gone_next UNION ALL SELECT source, number, shard FROM filled JOIN freed USING (turn)),
    passes AS (SELECT source AS pass_source, pass, list({KEY} ORDER BY i) AS keys FROM (SELECT source, unnest(range((goal - 1) // source_size + 1)) AS pass FROM goals), range({mixing.ROUNDS}) t(i) GROUP BY source, pass),
    slots AS (SELECT g.source, source_size, goal, full_blocks, shard, number // blocks AS pass, number % blocks AS slot FROM numbered n JOIN goals g ON n.source IS NOT DISTINCT FROM g.source),
    used AS (SELECT source, shard, CASE WHEN slot < full_blocks THEN list_reduce(list_prepend(slot, keys), lambda x, k: CASE WHEN (({HASH}) >> 10) % 2 = 1 THEN {OTHER} ELSE x END) ELSE full_blocks END AS block, least({mixing.BLOCK}, least(source_size, goal - s.pass * source_size) - slot * {mixing.BLOCK}) AS words
        FROM slots s JOIN passes p ON s.source IS NOT DISTINCT FROM p.pass_source AND s.pass = p.pass),
    pieces AS (SELECT row_id, source, start, size, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM placed WHERE size > 0),
    taken AS (SELECT row_id, sum(least(start + size, p.block * {mixing.BLOCK} + words) - greatest(start, p.block * {mixing.BLOCK}))::BIGINT AS taken, count(DISTINCT shard)::INTEGER AS n_shards FROM pieces p JOIN used u ON p.source IS NOT DISTINCT FROM u.source AND p.block = u.block WHERE least(start + size, p.block * {mixing.BLOCK} + words) > greatest(start, p.block * {mixing.BLOCK}) GROUP BY row_id)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_shards, 0)::INTEGER AS n_shards FROM placed LEFT JOIN taken USING (row_id) JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source"""


def _coverage(n: int) -> str:
    """Positions of words inside n-grams that a text has twice."""
    return f"""c{n} AS (SELECT DISTINCT row_id, i + k AS i FROM (SELECT row_id, i FROM (SELECT row_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT row_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})) QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1), range({n}) t(k)),
    r{n} AS (SELECT row_id, count(*) AS n{n}, sum(length(w[i])) AS x{n} FROM c{n} JOIN d USING (row_id) GROUP BY row_id)"""


LENGTHS = sorted(quality_rules.COVERAGE)
OP8 = f"""
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    lines AS (SELECT row_id, line, n, len(regexp_extract_all(line, '{WORD}')) AS words, list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: length(x))) AS chars FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d)),
    again AS (SELECT row_id, count(*) AS n_dup, sum(chars) AS dup_chars FROM (SELECT * FROM lines WHERE words > 0 QUALIFY row_number() OVER (PARTITION BY row_id, line ORDER BY n) > 1) GROUP BY row_id),
    {", ".join(_coverage(n) for n in LENGTHS)},
    x AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n5, 0)::BIGINT AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars, {", ".join(f"coalesce(x{n}, 0) AS x{n}" for n in LENGTHS)}
        FROM d LEFT JOIN again USING (row_id) {" ".join(f"LEFT JOIN r{n} USING (row_id)" for n in LENGTHS)}),
    y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dup_chars / nullif(word_chars, 0)::DOUBLE, 0) <= {quality_rules.LINE_COVERAGE}::DOUBLE AND {" AND ".join(f"coalesce(x{n} / nullif(word_chars, 0)::DOUBLE, 0) <= {quality_rules.COVERAGE[n]}::DOUBLE" for n in LENGTHS)} AS kept FROM y"""

ORACLE_SQL: dict[str, str] = {"op1_sharding": OP1, "op2_exact_dedup": OP2, "op3_substring_dedup": OP3, "op5_mixing": OP5, "op8_quality_rules": OP8}
