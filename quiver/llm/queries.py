"""The registered queries of the corpus operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import decontamination, line_dedup, media_columns, mixing, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filters
from quiver.llm.common import table

#: Budget tree of op4 and the pipeline: domain of a source, and weights per level.
DOMAINS = {f"src{i}": ("web" if i < 10 else "books" if i < 15 else "forums") for i in range(20)}
WEIGHTS = {"domain": {"web": 5, "books": 3, "forums": 2}, "language": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
SHARE, EPOCHS, SEED = 0.8, 2, 7


def tree() -> dict:
    domain = F.lit("other")
    for source, d in DOMAINS.items():
        domain = F.when(F.col("source") == source, F.lit(d)).otherwise(domain)
    return {"domain": domain, "language": F.col("lang"), "source": F.col("source")}


def tokens():
    """Four bytes a token."""
    return F.expr("(coalesce(octet_length(text), 0) + 3) div 4")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Lines shorter than this go as repeats only, not as near ones (op1).
NEAR_LINE = 16


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), near_least=NEAR_LINE)
    return left.select("doc_id", "n_lines", "n_repeated", "n_near", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP1_SQL = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as no from documents where text is not null),
d as (select line, length(line) n, min((doc_id, no)) f from l where line <> '' group by line),
c as (select * from d where n >= {NEAR_LINE}),
p as (select a.line x, a.f fx, b.line y, b.f fy from c a join c b on b.n = a.n and left(a.line, a.n // 2) = left(b.line, a.n // 2) and a.line <> b.line
union all select a.line, a.f, b.line, b.f from c a join c b on b.n = a.n and right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) and a.line <> b.line
union all select a.line, a.f, b.line, b.f from c a join c b on b.n = a.n + 1 and left(a.line, a.n // 2) = left(b.line, a.n // 2)
union all select a.line, a.f, b.line, b.f from c a join c b on b.n = a.n + 1 and right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)),
q as (select * from p where levenshtein(x, y) <= 1),
r as (select distinct line from (select case when fx < fy then y else x end as line from q)),
m as (select l.doc_id, l.no, l.line, d.line is not null and (doc_id, no) <> d.f as rep, r.line is not null and (doc_id, no) = d.f as near from l left join d using (line) left join r using (line))
select k.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_repeated, 0)::bigint n_repeated, coalesce(n_near, 0)::bigint n_near, md5(coalesce(t, '')) as kept_md5 from documents k left join (select doc_id, count(*) n_lines, count_if(rep) n_repeated, count_if(near) n_near, string_agg(line, chr(10) order by no) filter (not rep and not near) t from m group by 1) using (doc_id)"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), tree(), WEIGHTS, tokens(), share=SHARE, max_epochs=EPOCHS, seed=SEED)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_language").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").cast("bigint").alias("epoch"))


def op4_sql() -> str:
    domain = "case " + " ".join(f"when source = '{s}' then '{d}'" for s, d in DOMAINS.items()) + " else 'other' end"
    steps, above, last = [], [], "leaves"
    for level in ("domain", "language", "source"):
        w = "case " + " ".join(f"when {level} = '{v}' then {n}" for v, n in WEIGHTS[level].items()) + " else 1 end"
        keys = ", ".join([*above, level])
        part = "partition by " + ", ".join(above) if above else ""
        steps.append(f"""
f_{level} as (select {keys}, sum(capacity)::bigint c, any_value(given) b, {w} w from {last} group by {keys}),
g_{level} as (select *, c / w r from f_{level}),
h_{level} as (select *, (sum(c) over ({part} order by r, {level} rows unbounded preceding) - c)::bigint c_before, (sum(w) over ({part}) - sum(w) over ({part} order by r, {level} rows unbounded preceding) + w)::bigint w_from from g_{level}),
i_{level} as (select *, (c * w_from <= (b - c_before) * w)::int fully from h_{level}),
j_{level} as (select *, (sum(c * fully) over ({part}))::bigint c_full, (sum(w * (1 - fully)) over ({part}))::bigint w_open from i_{level}),
k_{level} as (select {keys}, case when fully = 1 then c else ((b - c_full) * w) // greatest(w_open, 1) end given from j_{level}),
n_{level} as (select l.* exclude (given), k.given from {last} l join k_{level} k using ({keys}))""")
        above.append(level)
        last = f"n_{level}"
    return f"""with d as (select doc_id, coalesce({domain}, '') as domain, coalesce(lang, '') as language, coalesce(source, '') as source, (coalesce(strlen(text), 0) + 3) // 4 as n from documents),
s as (select domain, language, source, sum(n)::bigint t from d group by all),
leaves as (select *, t * {EPOCHS} as capacity, least(((sum(t) over ()) * {round(SHARE * 1000)}) // 1000, (sum(t * {EPOCHS}) over ()))::bigint as given from s),
{",".join(steps)},
e as (select *, case when t = 0 then 0 else given // t end as epochs from n_source),
x as (select d.*, epochs, given - epochs * t as rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::varchar, 'null')) as k from d join e using (domain, language, source)),
y as (select *, sum(n) over (partition by domain, language, source order by k, n rows unbounded preceding) as til from x),
z as (select doc_id, domain, language, source, n, epochs as epoch from y where til <= rest union all select doc_id, domain, language, source, n, unnest(range(epochs::bigint)) from y)
select doc_id, domain, language as lang, source, n::bigint as n_tokens, epoch::bigint as epoch from z"""


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings and their resampled PCM are columns of the operator's result; digests of the stored PCM come from that column."""
    stored = media_columns.telephony(table(spark, sf_dir, "documents"))
    return stored.withColumns({"pcm_bytes": F.octet_length("pcm").cast("bigint"), "pcm_sha256": F.sha2("pcm", 256), "stored_bytes": F.octet_length("media").cast("bigint")}).drop("media", "pcm")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_strings(table(spark, sf_dir, "documents"), length=100, with_bytes=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", "fingerprint", "component_id", "n_links")


def url_list(pages: DataFrame) -> DataFrame:
    """Dated logs of three lists over the hosts of pages, by rule: half of the hosts and their domains are entered, some leave, some come back, and some are on two lists."""
    hosts = pages.select(url_filters.host_of("url").alias("pattern")).where("pattern <> ''").distinct()
    parents = hosts.select(F.regexp_extract("pattern", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct()
    both = hosts.union(parents).distinct().withColumn("h", F.expr("cast(conv(substring(md5(pattern), 1, 8), 16, 10) as bigint)")).where("h % 2 = 0")
    first = F.expr("cast(18262 + (h div 2) % 900 as int)")
    entry = lambda day, action, seq, own: F.struct(day.alias("day"), action.alias("action"), F.lit(seq).alias("seq"), F.concat(F.lit("list"), own.cast("string")).alias("category"))
    own, other = F.expr("h % 3"), F.expr("(h + 1) % 3")
    add, remove = F.lit("add"), F.lit("remove")
    log = F.array(
        entry(first, add, 1, own),
        entry(first + 200, F.when(F.expr("h % 4 = 0"), remove).otherwise(add), 2, own),
        entry(first + 400, F.when(F.expr("h % 8 = 0"), add).otherwise(remove), 3, own),
        entry(first + 400, F.when(F.expr("h % 16 = 0"), remove).otherwise(add), 4, F.when(F.expr("h % 5 = 0"), own).otherwise(other)),
        entry(first + 100, F.when(F.expr("h % 7 < 4"), add).otherwise(remove), 5, other),
        entry(first + 300, remove, 6, other),
    )
    return both.select("pattern", F.explode(log).alias("e")).select("pattern", "e.*")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetch_day", F.expr("cast(18262 + page_id % 1461 as int)"))
    return url_filters.filter_urls(pages, url_list(pages))


OP8_SQL = r"""with p as (select page_id, lower(regexp_replace(coalesce(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1), ''), '\.+$', '')) host, (18262 + page_id % 1461)::int fetch_day from pages),
h as (select distinct host as pattern from p where host <> ''),
b as (select pattern from h union select regexp_extract(pattern, '([^.]+\.[^.]+)$', 1) from h where regexp_extract(pattern, '([^.]+\.[^.]+)$', 1) <> ''),
x as (select pattern, ('0x' || substr(md5(pattern), 1, 8))::bigint as h from b),
l as (select pattern, h % 3 as own, (h + 1) % 3 as other, 18262 + (h // 2) % 900 as d, h from x where h % 2 = 0),
e as (select pattern, 'list' || own as category, d as day, 'add' as action, 1 as seq from l
union all select pattern, 'list' || own, d + 200, case when h % 4 = 0 then 'remove' else 'add' end, 2 from l
union all select pattern, 'list' || own, d + 400, case when h % 8 = 0 then 'add' else 'remove' end, 3 from l
union all select pattern, 'list' || (case when h % 5 = 0 then own else other end), d + 400, case when h % 16 = 0 then 'remove' else 'add' end, 4 from l
union all select pattern, 'list' || other, d + 100, case when h % 7 < 4 then 'add' else 'remove' end, 5 from l
union all select pattern, 'list' || other, d + 300, 'remove', 6 from l),
f as (select pattern, category, day, arg_max(action, seq) as action from e group by all),
v as (select *, coalesce(lead(day) over (partition by pattern, category order by day), 2147483647) as till from f),
m as (select p.page_id, count(*) n, max((length(v.pattern), v.pattern, v.category)) as best from p join v on v.action = 'add' and p.host <> '' and v.day <= p.fetch_day and p.fetch_day < v.till and (p.host = v.pattern or (ends_with(p.host, '.' || v.pattern) and contains(v.pattern, '.') and not regexp_matches(p.host, '^(\[.*|[0-9]+(\.[0-9]+){3})$'))) group by 1)
select p.page_id, p.host, p.fetch_day, coalesce(m.n, 0)::bigint as n_matches, m.best[2] as pattern, m.best[3] as category, m.n is not null as blocked from p left join m using (page_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_sharding, op4_mixing, op5_media_columns, op6_toxicity, op7_decontamination, op8_url_filters, op9_suffix_dedup, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_mixing": op4_sql(), "op8_url_filters": OP8_SQL}
