"""The queries opN_<name> over the standard tables, and their SQL where SQL expresses them.

Each applies its operator with production parameters to the whole table and
derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import crc_fold, read_table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.ngram_join import ngram_jaccard

    return ngram_jaccard(read_table(spark, sf_dir, "documents"), n=5, percent=80).drop("class_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import langid
    from nearfield.llm.tokens import tokenizer_path

    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    model = langid.train(docs, ~held_out, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.lm import lm_scores

    return lm_scores(read_table(spark, sf_dir, "documents"), "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 <> 0")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.decontam import contamination

    found = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    from nearfield.llm import spans as S

    counts = [S.counted(F.col("base"), k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(S.listed(F.col("base")), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.pii import KINDS, find_pii

    return _span_digest(find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")), KINDS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold("doc_id", 5) == 0
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.tokens import token_counts, tokenizer_path

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.ann import search

    return search(read_table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.secrets import KINDS, find_secrets

    return _span_digest(find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")), KINDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_language_id, op3_lm_scores, op4_decontaminate, op5_personal_data, op6_toxicity, op7_mix_sources, op8_token_counts, op9_multi_index, op10_secrets)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM docs, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
classes AS (SELECT r, min(r) OVER (PARTITION BY k) AS c FROM (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM grams GROUP BY r)),
own AS (SELECT g.r, g.g FROM grams g JOIN classes c ON c.r = g.r AND c.c = c.r),
links AS (
  SELECT a.r AS x, b.r AS y FROM own a JOIN own b ON a.g = b.g AND a.r < b.r JOIN sizes m ON m.r = a.r JOIN sizes n ON n.r = b.r
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 80 * (min(m.n) + min(n.n) - count(*))),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
walk AS (SELECT DISTINCT c AS x, c AS y FROM classes UNION SELECT w.x, b.y FROM walk w JOIN sym b ON b.x = w.y),
root AS (SELECT x, min(y) AS root FROM walk GROUP BY x),
named AS (SELECT c.r, t.root, min(d.doc_id) OVER (PARTITION BY t.root) AS component_id, c.c FROM classes c JOIN root t ON t.x = c.c JOIN docs d ON d.r = c.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(n.component_id, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s ON s.r = d.r LEFT JOIN named n ON n.r = d.r
"""

_OP4 = rf"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM split, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hits AS (SELECT runs.r, runs.n, runs.i, windows.item_id FROM runs JOIN windows ON windows.g = runs.g AND windows.n = runs.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(found.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN words ON words.r = s.r LEFT JOIN found ON found.r = s.r
"""

_OP7 = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS key, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size, text FROM documents),
drawn AS (
  SELECT doc_id, key, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)
      / coalesce(greatest(0.1::DOUBLE, 1 / (1 + abs((length(text) - size + 1)::DOUBLE / greatest(size, 1) - 5) / 5)), 0.1::DOUBLE) AS draw FROM sized),
sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM drawn GROUP BY key),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2::DOUBLE AS cap FROM sources),
rates AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM weighed),
plan AS (SELECT key, source_size, least(cap, weight * max(rate) OVER ()) AS target FROM rates),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM plan),
ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.key ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn d JOIN rest p ON p.key = d.key)
SELECT doc_id, size, source_size, target, ((epochs + (before + size / 2::DOUBLE <= rest)::BIGINT) * size)::BIGINT AS taken FROM ordered
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = "regexp_replace(h, '[^0-9]', '', 'g')"
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INTEGER WHEN {_DIGITS}[-i]::INTEGER > 4 THEN 2 * {_DIGITS}[-i]::INTEGER - 9 ELSE 2 * {_DIGITS}[-i]::INTEGER END)) % 10 = 0"
_TURNED = "(substr(replace(h, ' ', ''), 5) || left(h, 4))"
_MOD97 = f"list_reduce(list_transform(range(1, len({_TURNED}) + 1), lambda i: ascii({_TURNED}[i])::BIGINT - CASE WHEN {_TURNED}[i] <= '9' THEN 48 ELSE 55 END), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) % 97 = 1"
#: kind, rank, pattern over ``x`` and the condition on a match ``h``.  _ is no part of a word there.
_PATTERNED = (
    ("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "t", "true"),
    ("ip", 1, "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "t", f"regexp_full_match(h, '{_BYTE}(\\.{_BYTE}){{3}}')"),
    ("card", 2, "[0-9](?:[ -]?[0-9])+", "t", f"len({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", 3, "\\+[0-9][ ().0-9-]+[0-9]", "t", f"len({_DIGITS}) BETWEEN 9 AND 15"),
    ("iban", 4, "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\\b", "replace(t, '_', '~')", _MOD97),
)
_AROUND = "lower(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substr(t, e + 1, 40))"
#: kind, rank, lengths, pattern, what must not stand before and after, words nearby.
_FIXED = (
    ("ssn", 5, (11,), "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9-]", "[0-9-]", "ssn|social security|tax id"),
    ("local", 6, (14, 12), "(\\([0-9]{3}\\) |[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}", "[0-9(.+-]", "[0-9-]", "phone|tel|call|mobile|fax"),
)


def _op5_sql() -> str:
    parts, kinds = [], ("email", "ip", "card", "phone")
    for kind, rank, pattern, source, valid in _PATTERNED:
        found = f"SELECT r, unnest(regexp_extract_all(x, '{pattern}')) AS h, unnest(regexp_split_to_array(x, '{pattern}')) AS g, generate_subscripts(regexp_split_to_array(x, '{pattern}'), 1) AS i FROM (SELECT r, {source} AS x FROM docs)"
        placed = f"SELECT r, h, sum(length(g) + coalesce(length(h), 0)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS e FROM ({found})"
        parts.append(f"SELECT r, '{kind}' AS kind, {rank} AS rank, e - length(h) AS s, e FROM ({placed}) WHERE h IS NOT NULL AND {valid}")
    for kind, rank, lengths, pattern, before, after, near in _FIXED:
        for n in lengths:
            starts = f"SELECT r, t, unnest(range(0, length(t) - {n - 1})) AS s FROM docs WHERE regexp_matches(t, '{pattern}')"
            fits = f"regexp_full_match(substr(t, s + 1, {n}), '{pattern}') AND NOT regexp_matches(substr(t, s, 1), '{before}') AND NOT regexp_matches(substr(t, e + 1, 1), '{after}')"
            parts.append(f"SELECT r, '{kind}' AS kind, {rank} AS rank, s, e FROM (SELECT r, t, s, s + {n} AS e FROM ({starts})) WHERE {fits} AND regexp_matches({_AROUND}, '{near}')")
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0)::BIGINT AS n_{k}" for k in kinds)
    name = "kind || ':' || s || ':' || e"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({' UNION ALL '.join(parts)}),
kept AS (SELECT * FROM found f WHERE rank < 4 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.r = f.r AND b.rank < 4 AND b.s < f.e AND f.s < b.e)),
listed AS (SELECT r, {counts}, string_agg({name}, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base, string_agg({name}, ',' ORDER BY s, rank, e) AS spans FROM kept GROUP BY r)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed USING (r)
"""


#: The other operators learn, search approximately, tokenise or test for randomness; tests hold them against plain versions.
ORACLES: dict[str, str] = {"op1_ngram_jaccard": _OP1, "op4_decontaminate": _OP4, "op5_personal_data": _op5_sql(), "op7_mix_sources": _OP7}
