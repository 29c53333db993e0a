"""Queries of the corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprints, mixing, ngram_join, pii, quality, substring_dedup, token_counts, url_filter

#: Labelled rows that the quality classifier is fitted to, at most.
QUALITY_ROWS = 6000


#: Weights of sources for mixing; all others weigh 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 8.0, "src2": 0.5, "src3": 3.0}
MIX = {"default_weight": 1.0, "budget": 1.0, "max_epochs": 4.0, "seed": 17}
#: Domains, hosts and paths that the URL filter blocks besides URLs found on several pages.
BLOCKED = ("ads-track.example.com", "ththon.example.com/de", "https://www.therth.example.org/en/", "thtion.example.net")
#: Byte-level BPE ranks that tokens are counted with.
RANKS = os.environ.get("ROOKERY_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_mixing(spark, d):
    """Documents repeated so that their sources reach the target weights, at most 4 epochs each."""
    return mixing.mix(_t(spark, d, "documents"), MIX_WEIGHTS, **MIX)


def op2_url_filter(spark, d):
    """Verdict on every page's URL: by blocked domains and paths, and URLs that several pages have."""
    pages = _t(spark, d, "pages")
    again = pages.groupBy(url_filter.normalised(F.col("url")).alias("rule")).agg(F.count("*").alias("n")).where("n > 1").select("rule")
    fixed = spark.createDataFrame([(x,) for x in BLOCKED], "rule string")
    return url_filter.verdicts(pages, again.union(fixed))


OP2_SQL = f"""
with p as (select page_id, url, {url_filter.NORMALISED_SQL.format(u="url")} as norm from pages),
raw as (select norm as rule from p group by norm having count(*) > 1 union all select {url_filter.NORMALISED_SQL.format(u="x")} from (values {", ".join(f"('{x}')" for x in BLOCKED)}) t(x)),
rules as (select distinct rule from raw where rule <> ''),
k as (select *, regexp_extract(norm, '^([^/?]*)', 1) as host, regexp_replace(norm, '\\?.*$', '') as path from p),
b as (select k.page_id, k.url, r.rule, row_number() over (partition by k.page_id, k.url order by length(r.rule) desc) as n
      from k join rules r on k.norm = r.rule or k.path = r.rule or starts_with(k.path, r.rule || '/') or k.host = r.rule or (contains(r.rule, '.') and ends_with(k.host, '.' || r.rule)))
select k.page_id, k.url, b.rule is not null as blocked, b.rule from k left join b on b.page_id = k.page_id and b.url = k.url and b.n = 1"""


def op3_substring_dedup(spark, d):
    """Passages of 16 words or more that other places of the corpus repeat."""
    return substring_dedup.repeats(_t(spark, d, "documents"))


def op4_fingerprints(spark, d):
    """Of every document the least id with the same canonical text, and how many there are."""
    return fingerprints.fingerprints(_t(spark, d, "documents")).select("doc_id", "keep_id", "copies")


def op5_ngram_join(spark, d):
    """Every document that others equal or resemble (Jaccard of word 5-gram sets 0.5 or more), with its class and its links."""
    return ngram_join.near_classes(_t(spark, d, "documents"), n=5, threshold=0.5)


OP5_SQL = """
with recursive w as materialized (select distinct doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') as w from documents where text is not null),
k as materialized (select doc_id, list_sort(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end)) as grams from w where len(w) > 0),
s as materialized (select grams, len(grams) as size, count(*) as copies, min(doc_id) as rep from k group by grams),
g as materialized (select row_number() over () as n, size, copies, rep, grams from s),
u as materialized (select n, unnest(grams) as gram from g),
p as materialized (select a.n as a, b.n as b from u a join u b on a.gram = b.gram and a.n <> b.n join g x on x.n = a.n join g y on y.n = b.n group by a.n, b.n, x.size, y.size having count(*) >= 0.5 * (x.size + y.size - count(*)) - 1e-9),
r as (select n as node, n as top from g union select p.b, r.top from r join p on p.a = r.node),
c as (select node, min(x.rep) as class_id from r join g x on x.n = r.top group by node)
select k.doc_id, c.class_id, g.copies, (select count(*) from p where p.a = g.n) as links
from k join g on g.grams = k.grams join c on c.node = g.n where g.copies > 1 or exists (select 1 from p where p.a = g.n)"""


def op6_decontaminate(spark, d):
    """Documents that hold a benchmark item or 13 words of one, with the longest overlap of each."""
    return decontaminate.leaks(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


def op7_chat(spark, d):
    """Conversations as canonical JSON, user turns linked as calls to the assistant's answers."""
    return chat.format_chats(*chat.turns_as_calls(_t(spark, d, "conversations")), chat.ASK_SCHEMAS)


OP6_SQL = """
with d as materialized (select row_number() over () as k, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') as w from (select distinct doc_id, text from documents where text is not null)),
q as materialized (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') as w from benchmark where text is not null),
dt as (select k, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
qt as (select item_id, len(w) as size, unnest(w) as word, generate_subscripts(w, 1) - 1 as j from q),
e as materialized (select k, item_id, size, i - j as shift, list(j) as js from dt join qt using (word) group by k, item_id, size, i - j having count(*) >= 0.75 * least(13, size)),
b as (select e.*, doc_id, greatest(0, -shift) as lo, least(size, len(d.w) - shift) as hi from e join d using (k)),
s as materialized (select k, doc_id, item_id, size, shift, x, len(list_filter(js, lambda j: j < x)) as n from (select *, unnest(range(lo, hi + 1)) as x from b)),
l as (select f.k, f.doc_id, f.item_id, f.size, f.shift, t.x - f.x as n_tokens, t.n - f.n as n_equal, f.x + f.shift as first_token,
  row_number() over (partition by f.k, f.item_id, f.shift order by t.x - f.x desc, t.x) as r
  from s f join s t on t.k = f.k and t.item_id = f.item_id and t.shift = f.shift and t.x > f.x where t.n - f.n >= 0.75 * (t.x - f.x) - 1e-9),
o as (select *, row_number() over (partition by k, item_id order by n_equal desc, first_token, n_tokens) as best from l where r = 1 and n_tokens >= least(13, size))
select doc_id, item_id, first_token, cast(n_tokens as integer) as n_tokens, cast(n_equal as integer) as n_equal from o where best = 1"""


OP7_SQL = """
with c as materialized (select conv_id, turn, role, text, conv_id || ':' || last(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, case when role = 'user' then 0 else 1 end rows between unbounded preceding and current row) as asked
  from conversations where conv_id is not null),
r as (select conv_id, asked, count(*) as n, string_agg(to_json(coalesce(text, ''))::varchar, ',' order by coalesce(text, '')) as results from c where role = 'assistant' group by conv_id, asked),
e as (select conv_id, turn, asked as call_id, text, list_filter([case when text is null then '"$.query: missing"' when length(text) not between 20 and 1500 then '"$.query: length"' end, case when turn is null then '"$.turn: missing"' when turn < 0 then '"$.turn: range"' end], lambda x: x is not null) as errors from c where role = 'user'),
k as (select e.conv_id, e.turn, coalesce(r.n, 0) as n, len(errors) > 0 as wrong, '{"arguments":{' || concat_ws(',', '"query":' || to_json(e.text)::varchar, '"turn":' || e.turn) || '}' || case when len(errors) > 0 then ',"errors":[' || array_to_string(errors, ',') || ']' else '' end
  || ',"id":"' || call_id || '","name":"ask","results":[' || coalesce(r.results, '') || ']}' as call from e left join r on r.conv_id = e.conv_id and r.asked = e.call_id),
ks as (select conv_id, string_agg(call, ',' order by turn) as calls, count(*) as n, count(*) filter (n > 0) as answered, count(*) filter (wrong) as invalid from k group by conv_id),
ms as (select conv_id, string_agg('{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}', ',' order by turn nulls last, role, text) as messages from c where role is null or role not in ('user', 'assistant') group by conv_id),
os as (select r.conv_id, string_agg(results, ',' order by results) as orphans, sum(r.n) as n from r where asked is null or not exists (select 1 from e where e.conv_id = r.conv_id and e.call_id = r.asked) group by r.conv_id)
select i.conv_id, '{"calls":[' || coalesce(calls, '') || '],"messages":[' || coalesce(messages, '') || ']' || coalesce(',"orphans":[' || orphans || ']', '') || '}' as chat,
  cast(coalesce(ks.n, 0) as integer) as calls, cast(coalesce(answered, 0) as integer) as answered, cast(coalesce(invalid, 0) as integer) as invalid, cast(coalesce(os.n, 0) as integer) as orphans, 0 as cyclic
from (select distinct conv_id from c) i left join ks using (conv_id) left join ms using (conv_id) left join os using (conv_id)"""


def op8_token_counts(spark, d):
    """Tokens of every document before and after its identifiers are edited out."""
    return token_counts.redaction_counts(_t(spark, d, "documents"), RANKS)


def op9_pii(spark, d):
    """Documents without identifiers and without words that give them away."""
    return pii.sanitise(_t(spark, d, "documents"))


def op10_quality(spark, d):
    """Documents that the quality classifier accepts, with its probabilities."""
    docs = _t(spark, d, "documents")
    model, _ = quality.train(docs, _t(spark, d, "labels"), QUALITY_ROWS)
    return quality.accepted(docs, model)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_substring_dedup, op4_fingerprints, op5_ngram_join, op6_decontaminate, op7_chat, op8_token_counts, op9_pii, op10_quality)}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.mix_sql(MIX_WEIGHTS, **MIX), "op2_url_filter": OP2_SQL, "op4_fingerprints": fingerprints.SQL, "op5_ngram_join": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_chat": OP7_SQL}
