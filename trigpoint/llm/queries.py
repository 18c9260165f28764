"""The queries of this subpackage, with production parameters over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontam, htmltext, jaccard, langid, lexical, lm, packing, rollups, rules, toxicity, trie, urlfilter

#: Where the public vocabularies are; None: the package that comes with them.
TOKENIZERS: str | None = None
#: Tokenizer versions of op7.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: Rules of op8.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def vocabulary(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(k: int):
    return F.crc32(F.col("doc_id").cast("string")) % k


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    model = langid.learn(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), ~(remainder(4) == 2))
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "web-1")
    base_failed = (F.col("failed").bitwiseAND(rules.mask(rules.BASE)) != 0).alias("base_failed")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed, "kept")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op4's policy fails, and what it fails alone."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")), "web-1")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), remainder(7) == 2)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizer versions: all rows are inserted for both; the second one's counts, taken from the first at that time, are
    revised where the two differ, and merged with what came before; rows of under 20 words are deleted, and that batch is delivered twice."""
    old, new = VERSIONS
    counts = rollups.count_tokens(table(spark, sf_dir, "documents"), {v: vocabulary(f"{v}.tiktoken") for v in VERSIONS}, pattern())
    counts = common.staged(counts.select("source", "lang", "words", *(F.col("tokens")[v].alias(v) for v in VERSIONS)), "counts")
    path = f"{common.shared_dir(spark)}/trigpoint/{uuid.uuid4().hex}-rollup"
    common._written.append((spark, path))
    rollup = rollups.Rollup(spark, path)

    def deltas(rows: DataFrame, kind: str, tokenizer: str, tokens: str, before: str = "CAST(NULL AS BIGINT)") -> DataFrame:
        return rows.selectExpr(f"'{kind}' AS kind", "source", "lang", f"'{tokenizer}' AS tokenizer", f"{tokens} AS tokens", f"{before} AS old_tokens")

    short = counts.where("words < 20")
    removed = deltas(short, "delete", old, old).unionByName(deltas(short, "delete", new, new))
    rollup.commit("0001", deltas(counts, "insert", old, old))
    rollup.commit("0002", deltas(counts, "insert", new, old))
    rollup.commit("0003", deltas(counts.where(f"{old} <> {new}"), "revise", new, new, old))
    rollup.compact()
    rollup.commit("0004", removed)
    rollup.commit("0004", removed)
    return rollup.totals()


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~(remainder(3) == 1))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.LexicalIndex.build(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first crc32(c) mod 6 turns of conversation c - c mod 100."""
    keys = trie.turn_keys(table(spark, sf_dir, "conversations"))
    turns, convs = trie.rebuild(keys, F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100)
    return trie.prefix_trie(turns, convs)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_byte_bpe, op3_language_id, op4_quality_rules, op5_lm_score, op6_html_text, op7_token_counts, op8_url_filter, op9_toxicity, op10_decontaminate, op11_lexical_search, op12_best_fit_packing, op13_prefix_trie, rule_ablations)}

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table_name: str, key: str) -> str:
    return f"""SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
    FROM (SELECT {key}, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM {table_name})"""


_OP1 = f"""
WITH RECURSIVE s AS ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id"""

_MEASURED = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM m WHERE len(w) > 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM twice, range(0, 8) t(j) GROUP BY doc_id),
x AS (SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - length(regexp_replace(text, {_WORD}, '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.k, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits
  FROM m LEFT JOIN r ON r.doc_id = m.doc_id),
b AS (SELECT *, {" OR ".join(f"({rules.RULES[r]})" for r in rules.BASE)} AS base_failed FROM x)"""

_OP4 = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT ({" OR ".join(f"({r})" for r in rules.RULES.values())}) AS kept FROM b"""

_COUNTED = " + ".join(f"CAST(({r}) AS INT)" for r in rules.RULES.values())
_ABLATIONS = f"""{_MEASURED}
{" UNION ALL ".join(f"SELECT 'web-1' AS policy, '{name}' AS rule, count(*) FILTER ({rule}) AS n_failed, count(*) FILTER (({rule}) AND {_COUNTED} = 1) AS n_only, count(*) AS n_rows FROM x" for name, rule in rules.RULES.items())}"""

_OP8 = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in URL_RULES.items())}) t(rule, rhost, rpath, verdict)),
best AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict,
  CASE WHEN regexp_matches(p.host, '(^|[^0-9a-z])({"|".join(urlfilter.WORDS)})($|[^0-9a-z])') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id"""

_OP10 = f"""
WITH d AS ({_shingles("documents", "doc_id")}), q AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_shared
FROM d JOIN q ON d.g = q.g JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n"""

_OP11 = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM n, total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

_CRC_BYTE = "list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(c, b))"
_OP13 = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS size, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(conv_id AS VARCHAR)[k]) AS BIGINT)),
    lambda c, b: {_CRC_BYTE}, CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, o.i - c.h + least(c.h, coalesce(b.size, 0)), o.role, o.text
    FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (SELECT conv_id, i AS depth, list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY i) AS key, length(text) AS n FROM r
  UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]), 0 FROM c),
l AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
v AS (SELECT key, depth, count(*) AS n_convs, min(p.conv_id) AS conv_id, any_value(n) AS n,
    sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = size), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY key, depth),
k AS (SELECT key[:depth - 1] AS key, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
u AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (key)),
s AS (SELECT key[:j] AS key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * n) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM u) GROUP BY 1)
SELECT u.conv_id, u.depth, t.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, u.ends_sha256
FROM u JOIN s USING (key) LEFT JOIN u t ON u.depth > 0 AND t.key = u.key[:u.depth - 1]"""

ORACLE_SQL = {"op1_ngram_jaccard": _OP1, "op4_quality_rules": _OP4, "rule_ablations": _ABLATIONS, "op8_url_filter": _OP8, "op10_decontaminate": _OP10, "op11_lexical_search": _OP11, "op13_prefix_trie": _OP13}
