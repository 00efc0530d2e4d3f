"""The operators as registered queries: each applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import ann, common, decontaminate, heap_lloyd, language_id, packing, quality, simhash, substring_dedup, suffix_dedup, token_counts, topk, url_filter
from lexloom.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document because 100 bytes of it started earlier."""
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document because a chunk of it stood earlier, runs of 100 bytes or more."""
    docs, chunker = _table(spark, sf_dir, "documents"), substring_dedup.Chunker()
    return substring_dedup.report(substring_dedup.keyed_bytes(docs), substring_dedup.repeated(docs, chunker), chunker.least)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding among all others."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's shingles, with the counts."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    doc_id = F.when(F.col("__d") == common.NO_ID, None).otherwise(F.col("__d")).alias("doc_id")
    return found.select(doc_id, "item_id", "n_shared", "n_item", "containment")


OP5_SQL = """
with doc_words as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents),
item_words as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from benchmark),
doc_shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from doc_words where len(w) > 0)),
item_shingles as (
  select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from (select item_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from item_words where len(w) > 0)),
sizes as (select item_id, count(*) as n_item from item_shingles group by item_id),
shared as (select doc_id, item_id, count(*) as n_shared from doc_shingles join item_shingles using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from shared join sizes using (item_id)
where n_shared >= ceil(n_item * 0.8 - 1e-9)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labelled rows outside the held-out third."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: host, path and verdict of the rules that op8 applies.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides each page's address."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(rule) for rule in RULES) + " AS rules(host, path, verdict)")
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
with parts as (
  select page_id, url,
    case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from parts),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
  coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from split
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1,024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth embedding with all others."""
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


#: Usable vectors as lists of whole numbers, which doubles hold exactly.
_FLOORS = """select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

OP11_SQL = f"""
with v as ({_FLOORS}),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 4 parts, 256 entries each, 4 rounds of Lloyd."""
    return heap_lloyd.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def _op12_sql(rounds: int = 4) -> str:
    steps = [f"""
with v as materialized ({_FLOORS}),
x as materialized (select vec_id, label, p, e[1 + p * (len(e) // 4):(p + 1) * (len(e) // 4)] as e from v, range(4) r(p)),
c0 as materialized (select p, cast(row_number() over (partition by p order by vec_id) - 1 as bigint) as i, e from x where vec_id in (select vec_id from v order by vec_id limit 256))"""]
    for n in range(rounds + 1):
        # an entry's squared distance and its index in one number, so that the least is the nearest of the lowest index
        steps.append(f"""
a{n} as materialized (select vec_id, any_value(label) as label, x.p, any_value(x.e) as e,
  min(cast(list_dot_product(x.e, x.e) - 2 * list_dot_product(x.e, c.e) + list_dot_product(c.e, c.e) as bigint) * 256 + c.i) as near from x join c{n} c on x.p = c.p group by vec_id, x.p)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} as materialized (select c.p, c.i, coalesce(m.e, c.e) as e from c{n} c left join (
  select p, i, list(floor(s / n) order by pos) as e from (
    select p, near % 256 as i, pos, sum(e[pos]) as s, count(*) as n from a{n}, range(1, (select len(e) // 4 from v limit 1) + 1) d(pos) group by p, near % 256, pos) group by p, i) m on c.p = m.p and c.i = m.i)""")
    steps.append(f"""
coded as materialized (select vec_id, any_value(label) as label, string_agg(lower(format('{{:02x}}', near % 256)), '' order by p) as code, cast(sum(near // 256) as bigint) as error from a{rounds} group by vec_id)""")
    return ",".join(steps) + f"""
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(list_transform(e, lambda y: cast(cast(y as bigint) as varchar)), ','), ',' order by p, i)) from c{rounds}) as codebooks_sha256 from coded
"""


OP12_SQL = _op12_sql()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the five stages of corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_substring_dedup, op4_nearest, op5_decontaminate, op6_quality, op7_simhash, op8_url_filter, op9_language_id, op10_packing, op11_topk, op12_codes, pipeline)
}
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op8_url_filter": OP8_SQL, "op11_topk": OP11_SQL, "op12_codes": OP12_SQL}
