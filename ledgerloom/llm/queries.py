"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.backoff_lm import score_texts
from ledgerloom.llm.bpe import bpe_round_trip
from ledgerloom.llm.cross_tokenizer import align_tokenizers
from ledgerloom.llm.lexical_search import search
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.neighbour_graph import nearest
from ledgerloom.llm.order_minhash import near_duplicates
from ledgerloom.llm.pii import find_personal_data
from ledgerloom.llm.quality import quality_rules
from ledgerloom.llm.secret_scan import scan_secrets
from ledgerloom.llm.sharding import shard
from ledgerloom.llm.suffix_dedup import remove_repeats
from ledgerloom.llm.token_counts import count_tokens

#: Target weights of the production mix: ``src0`` five times any other source.
TARGETS = {"src0": 5.0}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 40)


def op2_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), TARGETS)


def op4_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir))


def op7_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op8_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op11_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op12_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


def op13_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_ALL = (
    op1_sampled_splitters,
    op2_token_efficiency,
    op3_poisson_mix,
    op4_longest_match,
    op5_nn_descent,
    op6_forced_boundaries,
    op7_bilstm_crf,
    op8_line_first,
    op9_order_minhash,
    op10_deep_shallow,
    op11_backoff_automaton,
    op12_byte_owners,
    op13_tput,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_MIX_SQL = """
WITH d AS (SELECT *, coalesce(octet_length(encode(text)), 0) + 1 AS bytes FROM documents),
s AS (SELECT source, sum(bytes) AS b, CASE WHEN source = 'src0' THEN 5.0 ELSE 1.0 END AS w FROM d GROUP BY source),
r AS (SELECT source, CAST(w AS DOUBLE) * (CAST((SELECT sum(b) FROM s) AS DOUBLE) / CAST((SELECT sum(w) FROM s) AS DOUBLE)) / CAST(b AS DOUBLE) AS rate FROM s),
p AS (SELECT source, list_transform(range(0, CAST(ceil(rate + 12 * sqrt(rate)) AS BIGINT) + 80), lambda k: exp(-rate + k * ln(rate) - lgamma(k + 1))) AS ps FROM r),
c AS (SELECT source, list_transform(range(1, len(ps) + 1), lambda k: list_sum(list_slice(ps, 1, k))) AS sums FROM p),
n AS (SELECT d.*, len(list_filter(c.sums, lambda x: x <= CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0)) AS n_copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
e AS (SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INTEGER) AS n_copies, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy FROM n)
SELECT *, md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS shuffle_key FROM e
"""

_SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT nd FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * (SELECT nd FROM s)) // (SELECT l FROM s))))) AS BIGINT) AS score
  FROM b JOIN t USING (term) JOIN w USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
ORACLE_SQL: dict[str, str] = {"op3_poisson_mix": _MIX_SQL, "op13_tput": _SEARCH_SQL}
