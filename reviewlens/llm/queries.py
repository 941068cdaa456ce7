"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.llm import (
    bpe, cross_polytope, exact_dedup, html_extract, mixing, paragraph_sketch, rule_ensemble, sharding, simhash, spelling,
    token_alignment, token_blocks, toxicity,
)
from reviewlens.llm.common import id_fold, prepare, shared_folder, stored, table

END_ID = 2
SHARDS = 40
QUALITY_FOLDS, QUALITY_HELD_OUT, QUALITY_THRESHOLD = 4, 2, 0.7
TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_THRESHOLD = 5, 0, 0.5
# Target weights of the mixture: the largest crawl source is held to the weight
# of the others, two sources are wanted more often.
MIX_WEIGHTS = {"src1": 2.0, "src2": 1.5}


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in patched frame-of-reference files and read back."""
    prepare(spark)
    folder = shared_folder(spark, "token-files")
    manifest = stored(spark, token_blocks.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, folder), "token-manifest")
    return token_blocks.with_starts(token_blocks.read_token_files(spark, folder), manifest)


def op2_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", TOXIC_FOLDS, TOXIC_HELD_OUT)
    return toxicity.scores(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    prepare(spark)
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, with their likeness."""
    prepare(spark)
    return paragraph_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated to the target weights of their sources and shuffled."""
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_FOLDS, QUALITY_HELD_OUT)
    return rule_ensemble.scored(docs, model, QUALITY_THRESHOLD).select(
        "doc_id", (id_fold(F.col("doc_id"), QUALITY_FOLDS) == QUALITY_HELD_OUT).alias("held_out"), "score", "predicted")


def op7_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shuffled shards of equal row counts."""
    prepare(spark)
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every document, as digests, and back."""
    prepare(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, with corpus-wide counts of the linked ids."""
    prepare(spark)
    documents, _ = token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                         public_tokenizers.path("piece_bpe_32k.model"))
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents added to a new digest index in two batches, each with the row that stays for its text."""
    prepare(spark)
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "digest-index"))
    found = exact_dedup.deduplicate_in_batches(table(spark, sf_dir, "documents"), index, batches=2)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words' number, its form and root."""
    prepare(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_blocks, op2_toxic_lexicon, op3_cross_polytope, op4_paragraph_sketch, op5_poisson_mix, op6_quality_rules,
    op7_two_pass_shards, op8_tree_scoring, op9_rank_queue_bpe, op10_simhash_trees, op11_perfect_hash_alignment,
    op12_digest_index, op13_chunk_join)}

# Weights, seed and step are written out apart from the code above.
POISSON_MIX_SQL = """
with recursive counted as (
  select source, count(*) as n,
         case source when 'src1' then 2.0::double when 'src2' then 1.5::double else 1.0::double end as weight
  from documents group by source
),
rate as (
  select source, (select sum(n) from counted)::double * weight / (select sum(weight) from counted) / n as mean from counted
),
step as (
  select source, greatest(ceil(mean / 32), 1)::integer as steps, mean / greatest(ceil(mean / 32), 1) as m from rate
),
cdf as (
  select source, m, 0 as k, exp(-m) as p, exp(-m) as c, floor(m + 12 * sqrt(m) + 20)::integer as last from step
  union all
  select source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1), last from cdf where k < last
),
draw as (
  select d.doc_id, d.source, j,
         ('0x' || substring(md5('42/' || d.doc_id || '/' || j), 1, 13))::bigint::double / 4503599627370496 as u
  from documents d join step s on d.source is not distinct from s.source, unnest(range(1, s.steps + 1)) as t(j)
),
part as (
  select w.doc_id, w.j, coalesce(min(c.k) filter (where c.c > w.u), max(c.k)) as k
  from draw w join cdf c on w.source is not distinct from c.source group by w.doc_id, w.j
),
total as (select doc_id, sum(k)::integer as copies from part group by doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, r::integer as replica, md5('order-42/' || d.doc_id || '/' || r) as mix_key
from documents d join total t on d.doc_id = t.doc_id, unnest(range(0, t.copies)) as x(r)
"""

DIGEST_INDEX_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
       text_sha256
from d window same as (partition by text_sha256)
"""

# CRC32 by its table, built from the polynomial; near words by deleting one code point.
CHUNK_JOIN_SQL = """
with recursive crc as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from range(256) as x(i)
),
met as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
),
told as (select doc_id, run, count(*) as times from met where length(run) >= 7 group by doc_id, run),
hashed as (
  select run, times, xor(list_reduce(
           flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
                                  lambda s: case when unicode(s) < 128 then [unicode(s)::bigint] else [195::bigint, unicode(s)::bigint - 64] end)),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h
  from told, crc
),
word as (
  select case when h % 31 = 0 then run[:(h % length(run))] || run[(h % length(run)) + 2:] else run end as word, sum(times)::bigint as n
  from hashed group by 1 having length(word) >= 7 and n >= 2
),
less as (select word, n, i, word[:i - 1] || word[i + 1:] as short from word, unnest(range(1, length(word) + 1)) as x(i)),
pair as (
  select x.word as word, y.word as other, y.n as n from less x join less y on x.short = y.short and x.i = y.i and x.word <> y.word
  union select x.word, y.word, y.n from less x join word y on x.short = y.word
  union select y.word, x.word, x.n from less x join word y on x.short = y.word
),
near as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from pair group by word),
form as (
  select w.word, w.n, coalesce(e.n_near, 0) as n_near, case when e.other_n >= 10 * w.n then e.other end as form,
         case when e.other_n >= 10 * w.n then e.other_n end as form_n
  from word w left join near e on w.word = e.word
),
step as (
  select word, word as at, form as ahead from form
  union all
  select s.word, f.word, f.form from step s join form f on s.ahead = f.word
)
select f.word, f.form, s.at as root, f.n, f.n_near, f.form_n from form f join step s on f.word = s.word and s.ahead is null
"""

# The other operators train, hash with XXH64, permute with a generator or merge in loops,
# which SQL does not express; tests hold them against brute-force versions.
ORACLE_SQL = {"op5_poisson_mix": POISSON_MIX_SQL, "op12_digest_index": DIGEST_INDEX_SQL, "op13_chunk_join": CHUNK_JOIN_SQL}
