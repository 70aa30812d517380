"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_dedup, doc_merkle, html_consensus, ngram_join, ppm_score, quality_cotrain, secret_scan, source_divergence, sp_viterbi, url_filter, vector_pack, vector_whiten, warc_fixity
from ._common import checkpointed, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cotrain.score(docs, quality_cotrain.train(docs, table(spark, sf_dir, "labels")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record with what the audit of a damaged replica finds.

    The replica stands for one read from another store: of the pages, those with
    id % 101 = 7 have a changed digest and those with id % 503 = 11 are gone.
    """
    primary = checkpointed(warc_fixity.layout(table(spark, sf_dir, "pages")))
    hurt = F.when(F.col("page_id") % 101 == 7, F.sha2("digest", 256)).otherwise(F.col("digest"))
    replica = primary.filter("page_id is null or page_id % 503 <> 11").withColumn("digest", hurt)
    built = warc_fixity.trees(primary)
    found = warc_fixity.audit(built, warc_fixity.trees(replica))
    rows = primary.join(found.select("file", "offset", "status", "replica_digest"), ["file", "offset"], "left").join(warc_fixity.roots(built), "file")
    return rows.select("page_id", "file", "offset", "length", "digest", "copies", F.coalesce("status", F.lit("ok")).alias("status"), F.when(F.col("status").isNull(), F.col("digest")).otherwise(F.col("replica_digest")).alias("replica_digest"), "root")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_viterbi.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.main_text(table(spark, sf_dir, "pages"))


#: Rules of the registered URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pack.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.score(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_fixity": op3_fixity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_main_text": op5_main_text,
    "op6_urls": op6_urls,
    "op7_fingerprints": op7_fingerprints,
    "op8_ngram_join": op8_ngram_join,
    "op9_near_vectors": op9_near_vectors,
    "op10_packing": op10_packing,
    "op11_scores": op11_scores,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {}


def _fixity_sql() -> str:
    nl, crlf = "chr(10)", "chr(13) || chr(10)"
    record = (
        f"'WARC/1.0' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Date: {warc_fixity.DATE}' || {crlf} || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || {crlf} "
        f"|| 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} || coalesce(html, '') || {crlf} || {crlf}"
    )
    levels = "".join(
        f", n{k + 1} AS (SELECT file, node >> {warc_fixity.FAN_BITS} AS node, sha256(string_agg(node || ' ' || hash, {nl} ORDER BY node)) AS hash FROM n{k} GROUP BY file, node >> {warc_fixity.FAN_BITS})" for k in range(warc_fixity.LEVELS)
    )
    return f"""WITH rec AS (SELECT page_id, sha256(r) AS digest, strlen(r) AS length, count(*) AS copies FROM (SELECT page_id, {record} AS r FROM pages) GROUP BY ALL),
      f AS (SELECT *, coalesce(CAST(CAST(floor(page_id / {warc_fixity.FILE_PAGES}) AS BIGINT) AS VARCHAR), 'null-' || left(digest, 2)) AS file FROM rec),
      l AS (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest) - length AS BIGINT) AS "offset" FROM f),
      n0 AS (SELECT file, "offset" >> {warc_fixity.LEAF_BITS} AS node, sha256(string_agg("offset" || ' ' || length || ' ' || digest, {nl} ORDER BY "offset", length, digest)) AS hash FROM l GROUP BY file, "offset" >> {warc_fixity.LEAF_BITS}){levels},
      t AS (SELECT file, sha256(string_agg(hash, {nl} ORDER BY hash)) AS root FROM n{warc_fixity.LEVELS} GROUP BY file)
      SELECT page_id, file, "offset", length, digest, copies, CASE WHEN page_id % 503 = 11 THEN 'missing' WHEN page_id % 101 = 7 THEN 'corrupt' ELSE 'ok' END AS status,
        CASE WHEN page_id % 503 = 11 THEN NULL WHEN page_id % 101 = 7 THEN sha256(digest) ELSE digest END AS replica_digest, root FROM l JOIN t USING (file)"""


def _merkle_sql() -> str:
    def tree(text: str) -> str:
        return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{doc_merkle.LEAF}'), lambda x: sha256(x))))"

    def joined(values: str, separator: str) -> str:
        return f"coalesce(list_aggregate({values}, 'string_agg', '{separator}'), '')"

    def printed(t: str) -> str:
        digest = "sha256(" + joined("{}", "") + ")"
        paragraphs = f"list_transform(s, lambda p: {{'d': {digest.format('p')}, 's': left({digest.format('p')}, {doc_merkle.INNER_HEX}) || '/' || {joined(f'list_transform(p, lambda x: left(x, {doc_merkle.LEAF_HEX}))', '')}}})"
        inner = digest.format("list_transform(q, lambda p: p.d)")
        text = joined("list_transform(q, lambda p: p.s)", ",")
        sections = f"list_transform(list_transform({t}, lambda s: {paragraphs}), lambda q: {{'d': {inner}, 's': left({inner}, {doc_merkle.INNER_HEX}) || '=' || {text}}})"
        return f"{digest.format(f'list_transform({sections}, lambda s: s.d)')} || ':' || {joined(f'list_transform({sections}, lambda s: s.s)', ';')}"

    def counted(text: str) -> str:  # leaves with their number of repetitions, from a row's text
        bare = f"regexp_replace(substr({text}, 66), '[0-9a-f]{{{doc_merkle.INNER_HEX}}}[=/]', '', 'g')"
        return f"SELECT doc_id, leaf, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({bare}, '[0-9a-f]{{{doc_merkle.LEAF_HEX}}}')) AS leaf FROM d) GROUP BY ALL"

    near = "CASE WHEN {p} = {q} THEN 1.0 WHEN coalesce(a.n, 0) + coalesce({t}.n, 0) = 0 THEN 0.0 ELSE 2.0 * coalesce({c}.n, 0) / (coalesce(a.n, 0) + coalesce({t}.n, 0)) END::DOUBLE"
    total = "(SELECT doc_id, sum(n)::BIGINT AS n FROM {t} GROUP BY doc_id)"
    common = "(SELECT x.doc_id, sum(least(x.n, y.n))::BIGINT AS n FROM la x JOIN {t} y ON x.doc_id = y.doc_id AND x.leaf = y.leaf GROUP BY 1)"
    return f"""WITH o AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM documents),
      e AS (SELECT doc_id, text, coalesce(next, '') AS next, left(text, length(text) - length(text) // 2) || left(coalesce(next, ''), length(text) // 2) AS edited FROM o),
      d AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {printed(tree('text'))} AS p, {printed(tree('edited'))} AS q, {printed(tree('next'))} AS r FROM e),
      la AS ({counted('p')}), lb AS ({counted('q')}), lc AS ({counted('r')})
      SELECT d.doc_id, n_chars, edited_sha256, p AS fingerprint, q AS edited_fingerprint, {near.format(p='p', q='q', t='b', c='ab')} AS near_edited, {near.format(p='p', q='r', t='c', c='ac')} AS near_next
      FROM d LEFT JOIN {total.format(t='la')} a ON d.doc_id = a.doc_id LEFT JOIN {total.format(t='lb')} b ON d.doc_id = b.doc_id LEFT JOIN {total.format(t='lc')} c ON d.doc_id = c.doc_id
      LEFT JOIN {common.format(t='lb')} ab ON d.doc_id = ab.doc_id LEFT JOIN {common.format(t='lc')} ac ON d.doc_id = ac.doc_id"""


_REACH = "reach AS (SELECT id, id AS other FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a)"

_JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pM\\pN_]+') AS words FROM documents),
  s AS (SELECT id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {ngram_join.N} THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - {ngram_join.N} + 2), lambda i: array_to_string(words[i:i + {ngram_join.N - 1}], ' ')) END) AS g FROM w),
  u AS (SELECT id, len(g) AS size, unnest(g) AS x FROM s), nodes AS (SELECT id, g, len(g) AS size FROM s),
  pairs AS (SELECT p.id AS a, q.id AS b, count(*) AS n, any_value(p.size) AS i, any_value(q.size) AS j FROM u p JOIN u q ON p.x = q.x AND p.id <> q.id GROUP BY 1, 2),
  links AS (SELECT a, b, n = i AND n = j AS same FROM pairs WHERE n >= {ngram_join.THRESHOLD} * (i + j - n) - 1e-9 UNION ALL SELECT p.id, q.id, true FROM nodes p JOIN nodes q ON p.id <> q.id WHERE p.size = 0 AND q.size = 0), {_REACH}
  SELECT nodes.id AS doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = nodes.id) AS n_links, 1 + (SELECT count(*) FROM links WHERE a = nodes.id AND same) AS n_copies FROM nodes JOIN reach ON nodes.id = reach.id GROUP BY nodes.id"""

_VECTOR_SQL = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  ok AS (SELECT * FROM nodes WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
  links AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.id <> q.id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= {cap_dedup.THRESHOLD}), {_REACH}
  SELECT nodes.id AS vec_id, (SELECT count(*) FROM links WHERE a = nodes.id) AS n_links, min(other) AS component_id, nodes.id = min(other) AS kept FROM nodes JOIN reach ON nodes.id = reach.id GROUP BY nodes.id"""

_DIVERGENCE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {source_divergence.MIN_DOCS}), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
  gn AS (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL), l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), ln AS (SELECT lang, sum(n) AS t FROM c GROUP BY ALL),
  p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(t, 0) + 2 * v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
  q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (t + 2 * v) AS q FROM l JOIN ln USING (lang) JOIN v USING (lang)),
  s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  f AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
    UNION ALL SELECT a.lang, a.source, 'pair', b.source, coalesce(value, 0) FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f QUALIFY part = 'pair' OR rank <= {source_divergence.BEST}"""

ORACLE |= {"op3_fixity": _fixity_sql(), "op7_fingerprints": _merkle_sql(), "op8_ngram_join": _JOIN_SQL, "op9_near_vectors": _VECTOR_SQL, "op12_divergence": _DIVERGENCE_SQL}
