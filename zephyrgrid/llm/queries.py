"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, jaccard, language_id, lm, merkle, mixing, packing, quality, repacking, secrets, sharding, topk, url_rules
from ..session import configure
from .text import crc32_text

QUERIES, ORACLES = {}, {}

# The rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc32_text(F.col("doc_id")) % 3 == 1)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, ("doc_id", "held_out"))


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    pieces = packing.pack(table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues", "continued")


@query("op3_topk", r"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
""")
def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_mixing")
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The budget is the corpus's own number of tokens, so that large sources are cut and small ones repeat."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, budget_tokens=mixing.token_total(docs))
    return mixed.select("doc_id", "source", "__mix.*")


@query("op5_url_rules", r"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (select page_id, host, path, h || p as rule, v,
    row_number() over (partition by page_id, host, path order by length(h || p) desc, length(h) desc) as k,
    cast(count(*) over (partition by page_id, host, path) as int) as n
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict, coalesce(n, 0) as matched_rules
from parts left join (select * from fits where k = 1) using (page_id, host, path)
""")
def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


@query("op6_jaccard")
def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.jaccard_join(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query("op7_secrets", r"""
with t as (select doc_id, coalesce("text", '') as "text", source from documents),
pats(kind, rank, pat) as (values
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{32,}'), ('owned', 3, '[A-Za-z0-9+/_-]{24,}')),
raw as (select doc_id, source, kind, rank, pat, regexp_extract_all("text", pat) as m, string_split_regex("text", pat) as g from t, pats),
placed as (select doc_id, source, kind, rank, pat, unnest(range(1, len(m) + 1)) as i, m, g from raw where len(m) > 0),
spans as (select doc_id, source, kind, rank, m[i] as v, pat,
    cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as int) as s from placed),
good as (select doc_id, source, kind, rank, v, s, s + cast(length(v) as int) as e from spans where case kind
  when 'assign' then length(regexp_extract(v, pat, 2)) >= 8 when 'access' then length(v) >= 16
  when 'hex' then length(v) >= 32 else regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]') end),
base as (select * from good where rank < 3),
loose as (select * from good g where rank = 3 and not exists (select 1 from base b where b.doc_id = g.doc_id and b.s < g.e and g.s < b.e)),
owners as (select v, count(distinct source) + max(cast(source is null as int)) as owners from good where rank = 3 group by v),
own as (select l.*, o.owners <= 3 as live from loose l join owners o using (v)),
every as (select * from base union all select * exclude (live) from own where live),
joined as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e) as spans from every group by doc_id),
basic as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e) as b,
    count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex
  from base group by doc_id),
left_out as (select doc_id, count(*) filter (not live) as n from own group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n, 0) as n_examples
from t left join basic using (doc_id) left join joined using (doc_id) left join left_out using (doc_id)
""")
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have owners (sources) and no repositories: a value is live by its owners, however often one of them repeats it."""
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), F.col("examples").alias("n_examples"))


@query("op8_log_bilinear")
def op8_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    held_out = crc32_text(F.col("doc_id")) % 7 == 2
    scored = lm.score_documents(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_quality", r"""
with t as (select row_number() over () as r, doc_id, source as host, coalesce("text", '') as "text" from documents),
w as (select r, doc_id, host, "text", list_filter(string_split_regex("text", '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split("text", chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
pos as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
win as (select r, i, [ws[i], ws[i + 1], ws[i + 2]] as x from pos),
rep as (select r, i from (select r, i, count(*) over (partition by r, x) as c from win) where c > 1),
cover as (select r, count(distinct i + k) as n from rep, (values (0), (1), (2)) as s(k) group by r),
m as (select w.r, doc_id, host, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace("text", '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from w left join cover using (r)),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, n_symbols > 0.5 * n_words as f_symbols,
    n_dup_lines > 0.05 * n_words as f_lines, n_words > 0 and not (word_chars between 2.0 * n_words and 15.0 * n_words) as f_lengths from m),
h as (select host, count(*) as docs, unnest(['base', 'symbols', 'lines', 'lengths']) as rule,
    unnest([count(*) filter (base_failed), count(*) filter (f_symbols), count(*) filter (f_lines), count(*) filter (f_lengths)]) as bad
  from f group by host),
c as (select rule, sum(bad) / sum(docs) as m from h group by rule),
v as (select rule, m, sum(docs * pow(bad / docs - m, 2)) / sum(docs) as v from h join c using (rule) group by rule, m),
s as (select rule, m, case when v > 0 then greatest(2.0, least(1000.0, m * (1 - m) / v - 1)) else 1000.0 end as a from v),
rates as (select host, max((bad + a * m) / (docs + a)) as rate from h join s using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.6 as kept,
  f.host as host, round(rate, 6) as host_rate
from f join rates on f.host is not distinct from rates.host
""")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(table(spark, folder, "documents"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_repacking")
def op11_repacking(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    pieces = repacking.pack(table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.drop("ids")


@query("op12_merkle", r"""
with recursive d as (select row_number() over () as r, doc_id, source, lang, n_chars, "text",
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda c: ascii(c)::ubigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::ubigint)),
        lambda x, z: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 2 = 0 as tampered from documents),
fields as (select r, doc_id, source, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head, "text",
    case when tampered then replace("text", chr(10), '') else "text" end as later from d),
leaves as (select r, doc_id, source, sha256(head || coalesce(strlen("text") || ':' || "text", '-')) as leaf,
    sha256(head || coalesce(strlen(later) || ':' || later, '-')) as later from fields),
ranked as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as i from leaves),
trees as (select source, 0 as l, i, leaf as h, count(*) over (partition by source) as n from ranked
  union all select source, l + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from trees where n > 1 group by source, l, i // 3),
subroots as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as k from trees where n = 1),
tops as (select 0 as l, k as i, subroot as h, count(*) over () as n from subroots
  union all select l + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from tops where n > 1 group by l, i // 3),
run as (select source, l, i, n, string_agg(h, '') over (partition by source, l, i // 3 order by i rows between unbounded preceding and 1 preceding) as b,
    string_agg(h, '') over (partition by source, l, i // 3 order by i rows between 1 following and unbounded following) as a from
  trees),
toprun as (select l, i, n, string_agg(h, '') over (partition by l, i // 3 order by i rows between unbounded preceding and 1 preceding) as b,
    string_agg(h, '') over (partition by l, i // 3 order by i rows between 1 following and unbounded following) as a from tops),
heights as (select source, max(l) as top from trees group by source),
steps as (select r, l as s, coalesce(b, '') as b, coalesce(a, '') as a from ranked
    join run on run.source is not distinct from ranked.source and run.i = ranked.i // cast(pow(3, l) as bigint) and run.n > 1
  union all select r, top + 1 + l, coalesce(b, ''), coalesce(a, '') from ranked
    join subroots on subroots.source is not distinct from ranked.source join heights on heights.source is not distinct from ranked.source
    join toprun on toprun.i = k // cast(pow(3, l) as bigint) and toprun.n > 1),
runs as (select r, row_number() over (partition by r order by s) as s, b, a from steps),
proofs as (select r, string_agg(b || a, '' order by s) as p from runs group by r),
fold as (select r, 1 as s, later as node from leaves
  union all select fold.r, fold.s + 1, sha256(b || node || a) from fold join runs on runs.r = fold.r and runs.s = fold.s),
folded as (select r, arg_max(node, s) as folded_root from fold group by r),
top as (select h as root from tops where n = 1)
select doc_id, leaf, subroot, root, sha256(coalesce(p, '')) as proof_sha256, folded_root, folded_root = root as verified
from ranked join subroots on subroots.source is not distinct from ranked.source cross join top left join proofs using (r) join folded using (r)
""")
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Tampering takes the line feeds out of the texts of half the documents."""
    tampered = crc32_text(F.col("doc_id")) % 2 == 0
    found = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, folder, "documents"), found={"text": found})


@query("op13_divergence", r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
tf as (select r, lang, source, term, count(*) as c from w group by all),
kept as (select lang, term from tf group by all having count(*) >= 10),
g as (select distinct lang, source from d),
v as (select l.lang, count(term) as v from (select distinct lang from g) l left join kept using (lang) group by l.lang),
c as (select lang, source, term, sum(c) as c from tf semi join kept using (lang, term) group by all),
n as (select lang, source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by all),
p as (select lang, source, term, coalesce(c, 0) as c, 1 + (cast(1000000000 as hugeint) * (coalesce(c, 0) + 2)) // (n + 2 * v) as p
  from g join kept using (lang) join n using (lang, source) join v using (lang) left join c using (lang, source, term)),
ln as (select lang, sum(n) as n from n group by lang),
q as (select lang, term, 1 + (cast(1000000000 as hugeint) * (sum(c) + 2)) // (any_value(n) + 2 * any_value(v)) as q
  from c join ln using (lang) join v using (lang) group by lang, term),
dist as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join dist on dist.lang = a.lang and dist.source = a.source and dist.item = b.source),
tops as (select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value
  from p join q using (lang, term) where c > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
  from (select * from pairs union all select * from tops))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
""")
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
