"""The queries of the operators over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddlework.llm import (
    alignment, chat, extraction, licenses, manifest, mixing, ngram_join, pieces, quality_classifier, quality_rules, sharding, topk, toxicity,
)
from heddlework.llm.common import prepare, staging

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The vocabulary of query 9; another folder can be named in the environment.
TOKENIZERS = os.environ.get("HEDDLEWORK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_license_scan")
def license_scan(spark, folder):
    scanned = licenses.license_scan(table(spark, folder, "documents").select("doc_id", "text"))
    found = [f"license.{n}" for n in "n_words n_base first_word last_word base_labels labels score".split()]
    return scanned.select("doc_id", *found, F.size("license.spans").cast("bigint").alias("n_spans"))


@query("op2_toxicity")
def toxicity_scores(spark, folder):
    stage = staging(spark, "toxicity")
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"), stage)


_RULES = ", ".join(
    f"('{name}', {sql.replace(' DIV ', ' // ')})" for name, (sql, _) in quality_rules.MEASURES.items()
)
_SLACKS = ", ".join(f"('{name}', {slack})" for name, (_, slack) in quality_rules.MEASURES.items())


@query(
    "op3_quality_rules",
    rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
words AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
triples AS (
  SELECT r, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS triple
  FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
again AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, triple) > 1 AS twice FROM triples WHERE triple IS NOT NULL),
repeated AS (
  SELECT r, count(DISTINCT pos + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) WHERE twice GROUP BY r),
counted AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
lined AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT d.r, doc_id, lang, source, coalesce(c.n_words, 0) AS n_words,
    coalesce(c.word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines,
    length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM docs d LEFT JOIN counted c ON c.r = d.r LEFT JOIN lined l ON l.r = d.r LEFT JOIN repeated p ON p.r = d.r),
measured AS (
  SELECT r, lang, source, m.name, m.value::BIGINT AS value
  FROM counts, LATERAL (VALUES {_RULES}) m(name, value)),
bucketed AS (
  SELECT *, (value >> greatest(length(bin(value)) - 5, 0)) << greatest(length(bin(value)) - 5, 0) AS bucket
  FROM measured),
sketch AS (SELECT lang, source, name, bucket, count(*) AS n FROM bucketed GROUP BY ALL),
levels AS (
  SELECT 'own' AS level, * FROM sketch
  UNION ALL SELECT 'lang', lang, NULL, name, bucket, sum(n) FROM sketch GROUP BY lang, name, bucket
  UNION ALL SELECT 'all', NULL, NULL, name, bucket, sum(n) FROM sketch GROUP BY name, bucket),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, name ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, name) AS everything FROM levels),
quarters AS (
  SELECT level, lang, source, name,
    min(CASE WHEN upto >= everything * 0.5 THEN bucket END) AS q50,
    min(CASE WHEN upto >= everything * 0.75 THEN bucket END) AS q75
  FROM ranked GROUP BY ALL),
limits AS (
  SELECT level, lang, source, q.name, q50 + {quality_rules.SPREAD} * (q75 - q50) + slack AS cut
  FROM quarters q JOIN (VALUES {_SLACKS}) s(name, slack) ON s.name = q.name),
cuts AS (
  SELECT o.lang, o.source, o.name, least(o.cut, l.cut, CASE WHEN o.name <> 'word_length' THEN a.cut END) AS cut
  FROM limits o JOIN limits l ON o.level = 'own' AND l.level = 'lang' AND l.lang IS NOT DISTINCT FROM o.lang AND l.name = o.name
    JOIN limits a ON a.level = 'all' AND a.name = o.name),
over_ AS (
  SELECT m.r, string_agg(m.name, ',' ORDER BY m.name) AS failed
  FROM measured m JOIN cuts c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
    AND m.name = c.name
  WHERE m.value > c.cut GROUP BY m.r),
based AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM based LEFT JOIN over_ ON over_.r = based.r
""",
)
def quality_rules_table(spark, folder):
    return quality_rules.quality_table(table(spark, folder, "documents"), staging(spark, "quality"))


@query("op4_quality_classifier")
def quality_scores(spark, folder):
    stage = staging(spark, "classifier")
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), stage)


@query("op5_sharding")
def shards(spark, folder):
    return sharding.shard_rows(table(spark, folder, "documents"), staging(spark, "shards")).drop("row_number")


@query(
    "op6_topk",
    f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {topk.QUERY_EVERY} = 0 AND q.r <> c.r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM scored)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= {topk.K}
""",
)
def nearest(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), staging(spark, "topk"))


#: The conversation whose texts hold control strings.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESCAPED = r"replace(replace(replace(t, '\', '\\'), '[', '[\'), '<', '<\')"


@query(
    "op7_chat_format",
    rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(CASE WHEN regexp_matches(t, '\[/?INST\]|</?s>|<<|>>') OR contains(t, '\') THEN {_ESCAPED} ELSE t END)
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 11 + 2 * CASE
        WHEN regexp_full_match(role, '[A-Za-z0-9_-]*') THEN length(role) ELSE 2 + 2 * strlen(role) END END AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + count(*) - 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
)
def chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


@query("op8_mixing")
def mixing_table(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), staging(spark, "mixing"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def tokenizer() -> pieces.Tokenizer:
    return pieces.Tokenizer(pieces.Vocabulary.load(f"{TOKENIZERS}/{VOCABULARY}"))


@query("op9_sentencepiece")
def piece_table(spark, folder):
    return pieces.encode_documents(table(spark, folder, "documents"), tokenizer())


@query("op10_ngram_join")
def ngram_components(spark, folder):
    return ngram_join.jaccard_join(table(spark, folder, "documents"), staging(spark, "ngrams"))


#: The byte-level vocabulary of query 11, beside that of query 9.
BYTE_VOCABULARY = "byte_bpe_50k.json"


@query("op11_alignment")
def token_alignment(spark, folder):
    both = alignment.Tokenizers(f"{TOKENIZERS}/{BYTE_VOCABULARY}", f"{TOKENIZERS}/{VOCABULARY}")
    return alignment.align_documents(table(spark, folder, "documents"), both, staging(spark, "alignment"))


_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# The SQL takes what the given pages call their article; the query has to find it.
@query(
    "op12_html_extraction",
    rf"""
WITH inside AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
cut AS (
  SELECT page_id, url, regexp_split_to_array(replace(regexp_replace(a, '</?b>', '', 'g'), '<br>', ' '), '</?(?:h1|p)>') AS parts FROM inside),
read AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(
    regexp_replace(replace(p, '&quot;', '"'), '&amp;?', '&', 'g'), '{_BLANK}', ' ', 'g'))), lambda p: p <> '') AS parts FROM cut)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM read
""",
)
def html_extraction(spark, folder):
    pages = table(spark, folder, "pages")
    return extraction.extract_text(pages, extraction.train(pages))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a source and of the sources that the SQL below spells out.
_LEVELS, _TOP_LEVELS = 7, 4


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        values = [text if name == "text" else f"{name}::VARCHAR" for name in manifest.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"

    def level(name: str, k: int, by: str) -> str:
        return f"""
{name}{k + 1} AS (
  SELECT {by}, nth // 16 AS nth, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY nth)) AS digest
  FROM {name}{k} WHERE n > 1 GROUP BY {by}, nth // 16, n),
{name}s{k} AS (
  SELECT {by}, nth, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY {by}, nth // 16 ORDER BY nth)),"""

    def ends(name: str, levels: int, by: str) -> str:
        return " UNION ALL ".join(f"SELECT {by}, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1))

    folded, proof, joins = "coalesce(shown, leaf)", [], []
    steps = [("n", k, f"c.source IS NOT DISTINCT FROM {{}}.source AND c.nth // {16 ** k} = {{}}.nth") for k in range(_LEVELS)]
    steps += [("t", k, f"o.nth // {16 ** k} = {{}}.nth") for k in range(_TOP_LEVELS)]
    chain = []
    for name, k, on in steps:
        s = f"{name}s{k}"
        joins.append(f"LEFT JOIN {s} ON " + on.format(s, s))
        proof.append(f"coalesce({s}.l || {s}.r, '')")
        chain.append(f"CASE WHEN {s}.nth IS NOT NULL THEN [{s}.l, {s}.r] END")
    bits = "flatten(list_transform(range(1, length(d) + 1), lambda i: [ord(d[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"""xor(list_reduce(list_prepend(4294967295, {bits}),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
    return f"""
WITH docs AS (
  SELECT *, doc_id::VARCHAR AS d FROM documents),
leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS shown FROM docs),
c AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
n0 AS (SELECT source, nth, n, leaf AS digest FROM c),{"".join(level("n", k, "source") for k in range(_LEVELS))}
subroots AS ({ends("n", _LEVELS, "source")}),
o AS (
  SELECT 0 AS one, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth, count(*) OVER () AS n FROM subroots),
t0 AS (SELECT one, nth, n, digest FROM o),{"".join(level("t", k, "one") for k in range(_TOP_LEVELS))}
roots AS ({ends("t", _TOP_LEVELS, "one")}),
proven AS (
  SELECT doc_id, leaf, shown, o.digest AS subroot, roots.digest AS root, sha256({" || ".join(proof)}) AS proof_sha256,
    list_filter([{", ".join(chain)}], lambda s: s IS NOT NULL) AS way
  FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source CROSS JOIN roots {" ".join(joins)}),
shut AS (
  SELECT *, list_reduce(list_prepend(['', {folded}], way), lambda a, s: ['', sha256(s[1] || a[2] || s[2])])[2] AS folded_root FROM proven)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM shut
"""


@query("op13_merkle_manifest", _merkle_sql())
def merkle_manifest(spark, folder):
    """All documents proven; where 5 divides crc32(doc_id) the text shown is in lower case."""
    stage = staging(spark, "manifest")
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf_digest(text=F.translate("text", _UPPER, _LOWER)))
    built = manifest.build(table(spark, folder, "documents"), stage, presented=shown)
    return manifest.verified(manifest.prove(built, stage))
