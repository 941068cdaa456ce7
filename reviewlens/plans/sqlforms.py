"""DuckDB SQL of the oracle checks, composed from common table expressions.

Each oracle query re-states in plain SQL what the Spark side computes, on the
same parquet views. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

# Values are written out here, apart from the library's constants, so that a
# wrong constant cannot pass both sides.
SEGMENTS = [
    (500, "1.<500"), (2000, "2.500 to 2k"), (4000, "3.2k to 4k"), (6000, "4.4k to 6k"), (8000, "5.6k to 8k"),
    (10000, "6.8k to 10K"), (12000, "7.10K to 12k"), (14000, "8.12K to 14k"), (16000, "9.14K to 16k"),
    (18000, "10.16K to 18k"), (20000, "11.18K to 20k"),
]
NEGATE = """'not', 'no', 'never', 'none', 'nobody', 'nothing', 'neither', 'nor', 'nowhere', 'cannot', 'without',
  'isnt', 'dont', 'doesnt', 'didnt', 'wasnt', 'wont', 'cant'"""
BOOST = """'absolutely', 'completely', 'extremely', 'highly', 'incredibly', 'most', 'really', 'so', 'totally', 'very'"""
DAMPEN = "'barely', 'hardly', 'less', 'little', 'slightly', 'somewhat'"

# Reviews view of documents + orders + labels (same rule as the Spark adapter).
REVIEWS = """reviews as (
  select cast(d.doc_id as varchar) as reviewID,
         cast(o.o_custkey as varchar) as reviewerID,
         d.source as asin,
         d.text as reviewText,
         concat_ws(' ', d.lang, d.source) as summary,
         o.o_orderstatus = 'F' as verified,
         cast(substring(o.o_orderpriority, 1, 1) as double) as overall,
         cast(epoch(o.o_orderdate) as bigint) as unixReviewTime,
         cast(l.quality as bigint) as label
  from documents d
  join orders o on o.o_orderkey = d.doc_id
  left join labels l on l.doc_id = d.doc_id
)"""

# Scoring view: documents without a label row.
SCORING = """scoring as (
  select cast(d.doc_id as varchar) as reviewID,
         cast(o.o_custkey as varchar) as reviewerID,
         d.source as asin,
         d.text as reviewText,
         concat_ws(' ', d.lang, d.source) as summary,
         o.o_orderstatus = 'F' as verified,
         cast(substring(o.o_orderpriority, 1, 1) as double) as overall,
         cast(epoch(o.o_orderdate) as bigint) as unixReviewTime
  from documents d
  join orders o on o.o_orderkey = d.doc_id
  where not exists (select 1 from labels l where l.doc_id = d.doc_id)
)"""

# Relational reviews view of lineitem + orders.
LINE_REVIEWS = """line_reviews as (
  select cast(li.l_orderkey as varchar) || '-' || cast(li.l_linenumber as varchar) as reviewID,
         cast(o.o_custkey as varchar) as reviewerID,
         cast(li.l_partkey as varchar) as asin,
         li.l_returnflag = 'N' as verified,
         li.l_quantity as overall,
         cast(epoch(o.o_orderdate) as bigint) as unixReviewTime
  from lineitem li join orders o on li.l_orderkey = o.o_orderkey
)"""


def date_of(epoch: str) -> str:
    return f"cast(make_timestamp(cast({epoch} as bigint) * 1000000) as date)"


def combined(text: str = "reviewText", summary: str = "summary") -> str:
    return f"lower(concat_ws(' ', {text}, {summary}))"


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '[-? ! , .]+', ' ', 'g')"


def segment_no(x: str) -> str:
    parts = [f"when {x} < {b} then {i}" for i, (b, _) in enumerate(SEGMENTS, start=1)]
    return f"(case {' '.join(parts)} when {x} >= 20000 then 12 else 13 end)"


def segment_label(x: str) -> str:
    parts = [f"when {x} < {b} then '{label}'" for b, label in SEGMENTS]
    return f"(case {' '.join(parts)} when {x} >= 20000 then '12.20k+' else '13.Other' end)"


def dedup(source: str, keys: str = "reviewerID, asin", name: str = "dedup") -> str:
    """Latest review per key, then smallest reviewID."""
    return f"""{name} as (
  select * exclude (_rn) from (
    select *, row_number() over (partition by {keys}
                                 order by unixReviewTime desc nulls last, reviewID asc nulls first) as _rn
    from {source}) where _rn = 1
)"""


# Length-study rows: dedup -> dates -> null drop -> collapse -> length -> segment.
LENGTH_STUDY = f"""{dedup('reviews')},
length_study as (
  select reviewID, reviewerID, asin, verified, overall, label,
         {date_of('unixReviewTime')} as reviewTime,
         {collapse(combined())} as reviewTot,
         length({collapse(combined())}) as reviewTot_length
  from dedup where reviewText is not null and label is not null
),
lt as (
  select *, year(reviewTime) as year, month(reviewTime) as month,
         dayofweek(reviewTime) + 1 as day_of_week, 2023 - year(reviewTime) as age,
         {segment_no('reviewTot_length')} as segment_no,
         {segment_label('reviewTot_length')} as reviewTot_segment
  from length_study
)"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens_of(expr: str, pattern: str = r"\W") -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '{pattern}'), lambda x: x <> '')"


def sentiment_tokens_of(expr: str) -> str:
    """Apostrophes dropped, then tokens."""
    return tokens_of(f"replace(replace({expr}, chr(39), ''), chr(8217), '')")


# Fixture lexicon from the benchmark table's words.
LEXICON = f"""lexicon as (
  select token,
         cast(ascii(token) % 9 - 4 as double) as valence,
         cast(ascii(token) % 9 - 4 as double) / 4 as polarity,
         cast(length(token) % 11 as double) / 10 as subjectivity
  from (select distinct unnest({sentiment_tokens_of('text')}) as token from benchmark)
)"""


def sentiment_ctes(source: str, prefix: str) -> str:
    """Token context, lexicon hits and per-review scores of ``source``
    (columns reviewID, reviewTot); defines ``{prefix}_scores``."""
    neg, boo, dam = NEGATE, BOOST, DAMPEN
    boosted = "(valence + boost * case when valence < 0 then -1.0 else 1.0 end)"
    return f"""{prefix}_toks as (
  select reviewID, arr, unnest(range(1, len(arr) + 1)) as i, coalesce(list_position(arr, 'but'), 0) as but_at,
         least(bangs, 4) * 0.292::double
         + case when asks <= 1 then 0.0 when asks <= 3 then asks * 0.18::double else 0.96 end as emphasis
  from (select reviewID, {sentiment_tokens_of('reviewTot')} as arr,
               length(reviewTot) - length(replace(reviewTot, '!', '')) as bangs,
               length(reviewTot) - length(replace(reviewTot, '?', '')) as asks from {source})
),
{prefix}_ctx as (
  select reviewID, arr[i] as tok,
         ((i > 1 and arr[i - 1] in ({neg})) or (i > 2 and arr[i - 2] in ({neg}))
          or (i > 3 and arr[i - 3] in ({neg}))) as negated,
         case when i > 1 and arr[i - 1] in ({boo}) then 0.293
              when i > 1 and arr[i - 1] in ({dam}) then -0.293 else 0.0 end as boost,
         case when but_at = 0 or i = but_at then 1.0 when i < but_at then 0.5 else 1.5 end as contrast, emphasis
  from {prefix}_toks
),
{prefix}_agg as (
  select reviewID,
         sum(cast(round((case when negated then {boosted} * -0.74 else {boosted} end) * contrast * 100000000.0) as bigint)) as s,
         max(cast(round(emphasis * 100000000.0) as bigint)) as strength,
         sum(cast(round((case when negated then polarity * -0.5 else polarity end) * 100000000.0) as bigint)) as ps,
         count(polarity) as pn,
         sum(cast(round(subjectivity * 100000000.0) as bigint)) as ss,
         count(subjectivity) as sn
  from {prefix}_ctx c join lexicon l on c.tok = l.token
  group by reviewID
),
{prefix}_scores as (
  select reviewID,
         cast(sd / sqrt(sd * sd + 15) as float) as compound_score,
         cast(coalesce((cast(ps as double) / 100000000.0) / nullif(cast(pn as double), 0), 0.0) as float) as polarity_score,
         cast(coalesce((cast(ss as double) / 100000000.0) / nullif(cast(sn as double), 0), 0.0) as float) as sentiment_score
  from (select *, cast(s + sign(s) * strength as double) / 100000000.0 as sd from {prefix}_agg)
)"""


def right_closed_bin_sql(x: str, edges) -> str:
    parts = [f"when cast({x} as double) <= {e} then '{i}'" for i, e in enumerate(edges, start=1)]
    return (f"(case {' '.join(parts)} when cast({x} as double) > {edges[-1]} then '{len(edges) + 1}' "
            f"else 'Unknown' end)")


# Sentiment-study rows: dedup -> null drop -> reviewTot -> scores (0 when no match) -> bins.
def sentiment_study() -> str:
    return f"""{dedup('reviews')},
sa_rows as (
  select reviewID, label, {combined()} as reviewTot
  from dedup where reviewText is not null and label is not null
),
{LEXICON},
{sentiment_ctes('sa_rows', 'sa')},
sa0 as (
  select r.reviewID, r.label,
         coalesce(s.compound_score, cast(0.0 as float)) as compound_score,
         coalesce(s.polarity_score, cast(0.0 as float)) as polarity_score,
         coalesce(s.sentiment_score, cast(0.0 as float)) as sentiment_score
  from sa_rows r left join sa_scores s on r.reviewID = s.reviewID
),
sa as (
  select *, case when compound_score > 0.5 or compound_score < -0.5 then 1 else 0 end as Predicted_Label,
         {right_closed_bin_sql('compound_score', [-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75])} as Bin,
         {right_closed_bin_sql('polarity_score', [0.0, 0.25, 0.5, 0.75])} as Bin_Pol,
         {right_closed_bin_sql('sentiment_score', [0.2, 0.4, 0.6, 0.8])} as Bin_Sen
  from sa0
)"""


def histogram_sql(source: str, x: str, bins: int = 50) -> str:
    return f"""h_vals as (select cast({x} as double) as x from {source}
                where {x} is not null and not isnan(cast({x} as double))),
h_rng as (select case when min(x) = max(x) then min(x) - 0.5 else min(x) end as lo,
                 case when min(x) = max(x) then max(x) + 0.5 else max(x) end as hi from h_vals),
h_cnt as (select cast(least({bins - 1}, floor((x - lo) / (hi - lo) * {bins})) as bigint) as bin, count(*) as c
          from h_vals, h_rng group by 1)
select cast(r.bin as bigint) as bin, lo + cast(r.bin as bigint) * ((hi - lo) / {bins}) as bin_lo,
       lo + (cast(r.bin as bigint) + 1) * ((hi - lo) / {bins}) as bin_hi,
       coalesce(c, 0) as count
from range({bins}) r(bin) cross join h_rng left join h_cnt on h_cnt.bin = r.bin"""


def auc_sql(source: str, score: str, label: str = "label") -> str:
    return f"""a_sc as (select cast({score} as double) as s, {label} as y from {source}
               where {score} is not null and {label} is not null),
a_g as (select s, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg
        from a_sc group by s),
a_c as (select s, pos, neg,
               coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below
        from a_g)
select cast(sum(pos * (below + 0.5 * neg)) as double)
       / (cast((select sum(pos) from a_g) as double) * cast((select sum(neg) from a_g) as double)) as auc
from a_c"""


def clean_sql(expr: str) -> str:
    """T3 -> T4 -> T5 in DuckDB."""
    return (f"regexp_replace(regexp_replace({collapse(expr)}, '\\d+', '', 'g'), "
            f"'[^\\w\\s]', '', 'g')")


def text_rows() -> str:
    """Model-notebook text columns of every review (no dedup, scoring path)."""
    from reviewlens.functions.stopwords import ENGLISH_STOP_WORDS
    stop = _sql_list(ENGLISH_STOP_WORDS)
    return f"""lg_raw as (select reviewID, label, {combined()} as raw_text from reviews),
lg_clean as (select reviewID, label, length(raw_text) as combined_text_length,
                    {clean_sql('raw_text')} as combined_text from lg_raw),
lg_tok as (select reviewID, combined_text, {tokens_of('combined_text')} as words from lg_clean),
lg_filt as (select reviewID, combined_text, words,
                   list_filter(words, lambda x: x not in ({stop})) as filtered from lg_tok)"""


def lg_features() -> str:
    """Model-notebook feature table in train mode (same order of steps)."""
    return f"""{LEXICON},
lg0 as (select reviewID, reviewerID, asin as productId, reviewText, summary,
               cast(verified as bigint) as verified, overall, unixReviewTime, label from reviews),
rc as (select reviewerID, count(*) as review_count from lg0 group by reviewerID),
pc as (select productId, count(*) as productId_count from lg0 group by productId),
lg1 as (select lg0.*, rc.review_count, pc.productId_count from lg0
        left join rc on lg0.reviewerID = rc.reviewerID left join pc on lg0.productId = pc.productId),
{dedup('lg1', 'reviewerID, productId', 'lgd')},
lg2 as (select * exclude (unixReviewTime), {date_of('unixReviewTime')} as reviewTime from lgd),
st as (select productId, count(distinct reviewID) as reviews_per_product,
              count(distinct reviewerID) as reviewers_per_product,
              datediff('day', min(reviewTime), max(reviewTime)) as product_review_interval
       from lg2 group by productId),
lg3 as (select lg2.*, st.reviews_per_product, st.reviewers_per_product, st.product_review_interval,
               row_number() over (partition by lg2.productId order by lg2.reviewTime desc, md5(lg2.reviewID), lg2.reviewID) as reviewOrder
        from lg2 join st on lg2.productId = st.productId),
lg4 as (select *, {combined()} as reviewTot, {clean_sql(combined())} as cleaned from lg3 where reviewText is not null and label is not null),
{sentiment_ctes('lg4', 'lgs')}"""


LG_FEATURES_SELECT = """
select l.reviewID, l.reviewerID, l.productId, l.verified, l.overall, l.label, l.reviewTime,
       year(l.reviewTime) as year, month(l.reviewTime) as month, dayofweek(l.reviewTime) + 1 as day_of_week,
       2023 - year(l.reviewTime) as age, l.review_count, l.productId_count, l.reviews_per_product,
       l.reviewers_per_product, l.product_review_interval, l.reviewOrder,
       round(cast(coalesce(s.polarity_score, cast(0.0 as float)) as double), 6) as polarity_score,
       round(cast(coalesce(s.sentiment_score, cast(0.0 as float)) as double), 6) as sentiment_score,
       length(l.reviewTot) as combined_text_length, l.cleaned as combined_text
from lg4 l left join lgs_scores s on l.reviewID = s.reviewID"""
