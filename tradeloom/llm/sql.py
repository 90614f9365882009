"""SQL with the same rows as the queries, written for DuckDB over the same tables."""

from __future__ import annotations

from tradeloom.llm.chat import Template
from tradeloom.llm.licenses import RULES, SENTENCES

WORD = r"[^\x20\x09-\x0D]+"

HOST_RULES = rf"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{WORD}') AS words FROM texts),
windows AS (
  SELECT r, i, words[i : i + 4] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT r, i + k AS place FROM twice, (SELECT unnest(range(5)) AS k)) GROUP BY r
),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r
),
measured AS (
  SELECT doc_id, source, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    base_failed OR 20 * n_symbols > n_words OR 5 * n_dup_lines > n_words
      OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed
  FROM measured
),
hosts AS (SELECT source, count(*) AS d, count(*) FILTER (failed) AS f FROM judged GROUP BY source),
sums AS (
  SELECT count(*) AS h, sum(d) AS n, sum(f) / sum(d) AS m, sum(d * d) AS s,
    sum(f * f / d) - sum(f) * (sum(f) / sum(d)) AS spread
  FROM hosts
),
prior AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 AND n - s / n > h - 1
    THEN least(greatest((spread / (m * (1 - m)) - (h - 1)) / (n - s / n - (h - 1)), 0.001), 0.999) ELSE 0.5 END AS b
  FROM sums
),
rates AS (SELECT source, (f + (1 / b - 1) * m) / (d + (1 / b - 1)) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""


def _keys(n: str, salt: str) -> str:
    """Round keys of a permutation of 0..n-1, as a list."""
    return (
        f"list_transform(range(12), lambda i: CAST('0x' || substr(md5('key:' || {salt} || ':' || i), 1, 15) AS BIGINT)"
        f" % greatest({n}, 1))"
    )


def _round(n: str, salt: str) -> str:
    """Place of ``x`` after round ``i`` of the permutation with these ``keys``."""
    other = f"(((keys[i + 1] - x) % {n} + {n}) % {n})"
    return (
        f"CASE WHEN substr(md5({salt} || ':' || i || ':' || greatest(x, {other})), 1, 1) >= '8' THEN {other} ELSE x END"
    )


MIXING = rf"""
WITH RECURSIVE sizes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size
  FROM documents
),
streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id, size, r
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM sizes
),
totals AS (SELECT source, sum(size)::BIGINT AS words FROM sizes GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM totals
),
budget AS (SELECT 1.5 * sum(words) AS b FROM totals),
-- The level is the one candidate at which the limited targets sum to the budget.
levels AS (
  SELECT a.number, (b - coalesce(sum(2.0 * c.words) FILTER (c.words / c.weight < a.words / a.weight), 0))
    / sum(c.weight) FILTER (c.words / c.weight >= a.words / a.weight) AS level, a.words / a.weight AS ratio
  FROM weighed a, weighed c, budget GROUP BY a.number, a.words, a.weight, b
),
level AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE 2 * ratio > level),
sources AS (
  SELECT *, ceil(words / 128)::BIGINT AS blocks,
    coalesce(round(target * ceil(words / 128) / nullif(words, 0)), 0)::BIGINT AS slots
  FROM (SELECT weighed.*, CASE WHEN 2 * words > coalesce(level, 0) * weight AND level IS NOT NULL
      THEN weight * level ELSE 2.0 * words END AS target FROM weighed, level)
),
opened AS (
  SELECT number, blocks, n, n // blocks AS pass FROM (SELECT number, blocks, unnest(range(slots)) AS n FROM sources)
),
keyed AS (
  SELECT number, pass, blocks AS m, '9s:' || number || ':' || pass AS salt, {_keys("blocks", "'9s:' || number || ':' || pass")} AS keys
  FROM (SELECT DISTINCT number, pass, blocks FROM opened)
),
walked AS (
  SELECT number, pass, n % blocks AS x, 0 AS i FROM opened
  UNION ALL
  SELECT number, pass, {_round("m", "salt")}, i + 1 FROM walked JOIN keyed USING (number, pass) WHERE i < 12
),
uses AS (SELECT number, x AS block, count(*) AS uses FROM walked WHERE i = 12 GROUP BY number, x),
placed AS (SELECT streams.*, number, words, target FROM streams JOIN sources ON streams.source IS NOT DISTINCT FROM sources.source),
pieces AS (
  SELECT r, number, block, least(first + size, (block + 1) * 128) - greatest(first, block * 128) AS part
  FROM (SELECT *, unnest(range((first // 128)::BIGINT, ((first + size - 1) // 128)::BIGINT + 1)) AS block FROM placed WHERE size > 0)
),
got AS (SELECT r, sum(part * uses) AS taken FROM pieces JOIN uses USING (number, block) GROUP BY r)
SELECT doc_id, size, words AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN got USING (r)
"""



def _license_scan() -> str:
    known = ", ".join(f"('{sentence}', '{name}')" for sentence, name in SENTENCES.items())
    steps, last = [], "spelled"
    for i, (name, run) in enumerate(RULES):
        spelled = "".join(f"<{one}>" for one in run)
        steps.append(
            f"s{i} AS (SELECT r, doc_id, identifiers, replace(rest, '{spelled}', '|') AS rest, CASE WHEN contains(rest, '{spelled}') "
            f"AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})"
        )
        last = f"s{i}"
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
cut AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(translate(
    regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
      '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'),
      '\n[\x20\x09-\x0D]*\n', chr(1), 'g'),
      '\n([\x20\x09-\x0D]*[^a-z\x20\x09-\x0D])', chr(1) || '\1', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)) AS parts
  FROM documents
),
parts AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
sequences AS (SELECT r, list(name ORDER BY i) AS names FROM parts JOIN known ON trim(part) = sentence GROUP BY r),
spelled AS (
  SELECT cut.r, doc_id, coalesce(array_to_string(names, ','), '') AS identifiers,
    coalesce('<' || array_to_string(names, '><') || '>', '') AS rest, CAST([] AS VARCHAR[]) AS names
  FROM cut LEFT JOIN sequences USING (r)
),
{", ".join(steps)}
SELECT doc_id, identifiers, array_to_string(names, ',') AS licenses,
  length(rest) - length(replace(rest, '<', '')) AS unmatched
FROM {last}
"""


def _chat() -> str:
    """Formatted sizes by the lengths of marks and escaped texts; digests straight from the rows."""
    template = Template()
    escaped = lambda column: f"length(regexp_replace({column}, '{template.control}', '\\1\\\\\\2\\3', 'g'))"
    marks = " ".join(f"WHEN '{role}' THEN {len(before + after)}" for role, before, after in template.roles)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({escaped("text")} + CASE role {marks}
    ELSE {len("".join(template.other))} + {escaped("role")} END) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
placed AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM lists, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(words) >= k
),
counts AS MATERIALIZED (
  SELECT lang, k, words[i : i + k - 1] AS phrase, count(*) AS f FROM placed GROUP BY ALL
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, cuts.f AS a, x.f AS l, y.f AS r, j,
    CAST(CAST(2000000 AS HUGEINT) * cuts.f // (x.f + y.f) AS BIGINT) AS score
  FROM cuts
  JOIN counts x ON x.lang = cuts.lang AND x.phrase = cuts.phrase[: j]
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = cuts.phrase[j + 1 :]
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, f, phrase[i : i + size - 1] AS phrase
  FROM (SELECT lang, f, phrase, k, size, unnest(range(1, k - size + 2)) AS i
    FROM candidates, (VALUES (2), (3)) AS sizes(size) WHERE size < k)
),
covering AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN covering USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
),
ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


ORACLES: dict[str, str] = {"op1_license_scan": _license_scan(), "op3_host_rules": HOST_RULES, "op9_mixing": MIXING, "op11_chat_formatting": _chat(), "op12_collocations": COLLOCATIONS}
