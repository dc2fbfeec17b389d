"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewell.llm.bpe import encode_decode
from probewell.llm.html_extract import extract
from probewell.llm.lattice import near_vectors
from probewell.llm.lexical import search
from probewell.llm.lines import dedup_lines
from probewell.llm.mixing import mix
from probewell.llm.pii import detect
from probewell.llm.sharding import shard_documents
from probewell.llm.simhash import near_duplicates
from probewell.llm.spelling import variants
from probewell.llm.suffix_dedup import remove_repeats
from probewell.llm.topk import top_k
from probewell.llm.toxicity import classify


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.95 or more, whatever their labels."""
    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced label propagation over links between equal texts, eight shards, law "rows"."""
    return shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labels that aren't held out."""
    return classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over shingles of four words, four differing bits at most."""
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), limit=4, shingle=4, seed=42)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by weights 1, 2, 3 in turn, at most three epochs."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, ["doc_id"], weights=(1, 2, 3), cap=3.0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text, and back."""
    return encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed."""
    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in five or more documents, kept in the largest doc_id only."""
    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=40, copies=5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more that occur five times or more, with their near words and forms."""
    return variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=6, times=5, factor=5, every=199)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice, op2_sharding, op3_toxicity, op4_html, op5_pii, op6_topk, op7_simhash, op8_mixing, op9_bpe, op10_suffix_dedup, op11_lines, op12_lexical, op13_spelling)}


#: Integer components by the contract, inner products by a join of every hundredth vector with all.
OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


#: Keys by trimming and replacing A-Z; counts of documents for each key.
OP11 = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), k AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id < f.top AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

#: Terms by a regular expression, integer scores by the contract.
OP12 = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY ALL),
 g AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 s AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN d USING (doc_id) JOIN f USING (term), g GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 50
"""

#: The checksum bit by bit over the UTF-8 bytes; near words by words less one letter, or with one letter masked.
OP13 = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), r AS (SELECT doc_id, run, count(*) AS k, concat(doc_id, ':', run) AS name FROM runs WHERE length(run) >= 6 GROUP BY ALL),
 bits AS (SELECT b, CAST(list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS BIGINT) AS v FROM (SELECT unnest(range(256)) AS b)),
 crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
 h AS (
  SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || substr(hex(name), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT) FOR i IN range(strlen(name))]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM r, crc
 ), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1
 ), v AS MATERIALIZED (SELECT word, n FROM w WHERE n >= 5 AND length(word) >= 6),
 less AS MATERIALIZED (SELECT DISTINCT word, n, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS short FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
 masked AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i - 1), '*', substr(word, i + 1)) AS m FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
 near AS (
  SELECT l.word, v.word AS other, v.n AS other_n FROM less l JOIN v ON l.short = v.word
  UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN v ON l.short = v.word
  UNION ALL SELECT a.word, b.word, b.n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
 ), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
 form AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)
 ), up AS (SELECT word, coalesce(form, word) AS root FROM form UNION ALL SELECT up.word, form.form FROM up JOIN form ON up.root = form.word WHERE form.form IS NOT NULL AND up.word <> up.root),
 last AS (SELECT up.word, arg_max(root, n) AS root FROM up JOIN v ON up.root = v.word GROUP BY up.word)
SELECT form.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM form JOIN last USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6, "op11_lines": OP11, "op12_lexical": OP12, "op13_spelling": OP13}
