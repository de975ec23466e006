"""Registered queries of news: documents as stories, by their source, with the pages' URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import clusters, news
from barlake.operators import relevance as rel
from barlake.plans import sql
from barlake.plans.more import CANON, LEXICON, _TITLE
from barlake.plans.queries import r4, register, table

AS_OF = "2024-06-01"
NEWS = f"""nw as (select doc_id as id, source as Symbol, doc_id % 5 = 0 as filing, case when doc_id % 3 = 0 then url end as url, text as title, case when doc_id % 7 != 0 then date '{AS_OF}' - (doc_id % 700)::int end as Published from documents left join pages on page_id = doc_id % (select count(*) from pages))"""


def stories(spark, sf_dir):
    """(id, Symbol, filing, url, title, Published); a third have URLs, a seventh no date."""
    d, p = panel.table(spark, sf_dir, "documents"), panel.table(spark, sf_dir, "pages").select("page_id", "url")
    n = p.agg(F.count(F.lit(1)).alias("_n"))
    k = F.col("doc_id")
    met = d.select("doc_id", "source", "text").join(F.broadcast(n)).withColumn("page_id", F.when(F.col("_n") > 0, k % F.col("_n"))).join(p.hint("shuffle_merge"), "page_id", "left")
    return met.select(k.alias("id"), F.col("source").alias("Symbol"), (k % 5 == 0).alias("filing"), F.when(k % 3 == 0, F.col("url")).alias("url"), F.col("text").alias("title"), F.when(k % 7 != 0, F.date_sub(F.lit(AS_OF).cast("date"), (k % 700).cast("int"))).alias("Published"))


def _event(text: str) -> str:
    quoted = ((label, pattern.replace("'", "''")) for label, pattern in news.EVENTS)
    return "case " + " ".join(f"when regexp_matches(lower({text}), '{p}') then '{label}'" for label, p in quoted) + f" else '{news.OTHER}' end"


@register("classify_event", f"select item_id, {_event('text')} as Event from benchmark")
def classify_event(spark, sf_dir):
    return panel.table(spark, sf_dir, "benchmark").select("item_id", news.classify_event(F.col("text")).alias("Event"))


@register("title_tokens", f"with t as (select item_id, list_distinct(list_filter(string_split({_TITLE.format('text')}, ' '), lambda x: length(x) > 2)) as t from benchmark) select item_id, len(t) as n, array_to_string(list_sort(t), ' ') as tokens from t")
def title_tokens(spark, sf_dir):
    t = news.title_tokens(F.col("text"))
    return panel.table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("n"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@register("cluster_key", f"with {NEWS} select id, case when coalesce({CANON}, '') != '' then concat_ws('::', 'u', Symbol, case when filing then 'f' else 'm' end, {CANON}) else concat_ws('::', 't', Symbol, case when filing then 'f' else 'm' end, {_TITLE.format('title')}) end as Cluster_Key from nw")
def cluster_key(spark, sf_dir):
    return stories(spark, sf_dir).select("id", news.cluster_key(F.col("Symbol"), F.col("filing"), F.col("url"), F.col("title")).alias("Cluster_Key"))


_AGE = f"date_diff('day', Published, date '{AS_OF}')"
_BIN = f"case when Published is null then 'Unknown_Date' when {_AGE} <= 7 then '0-7d' when {_AGE} <= 30 then '8-30d' when {_AGE} <= 90 then '31-90d' else '90d+' end"


@register("recency", f"with {NEWS} select id, {_BIN} as Recency from nw")
def recency(spark, sf_dir):
    return stories(spark, sf_dir).select("id", news.recency(F.datediff(F.lit(AS_OF).cast("date"), "Published")).alias("Recency"))


@register("news_prune", f"with {NEWS} select id from nw where Published is null or {_AGE} <= case when filing then 540 else 180 end")
def news_prune(spark, sf_dir):
    return news.news_prune(stories(spark, sf_dir), AS_OF).select("id")


@register("news_filter", f"with {NEWS} select id from nw where {_event('title')} = '{news.OTHER}' and {_BIN} = '31-90d' and not filing")
def news_filter(spark, sf_dir):
    s = stories(spark, sf_dir).withColumn("Event", news.classify_event(F.col("title")))
    return news.news_filter(s, AS_OF, news.OTHER, "31-90d", False).select("id")


@register("news_summary", f"with {NEWS} select Symbol, count(*) as Stories, count(*) filter (filing) as Filings, arg_min({_event('title')}, id) as First_Event, min({_AGE}) as Min_Age from nw group by 1")
def news_summary(spark, sf_dir):
    return news.news_summary(stories(spark, sf_dir).withColumn("Event", news.classify_event(F.col("title"))), AS_OF)


@register("news_feed", f"with {NEWS}, rk as (select source as Symbol, row_number() over (order by count(*) desc, source) as Rank from documents group by 1), k as (select Symbol, Rank, id, row_number() over (partition by nw.Symbol order by filing desc, Published desc nulls last, id) as Place from nw left join rk using (Symbol)) select * from k where Place <= 15")
def news_feed(spark, sf_dir):
    """Sources ranked by their number of stories."""
    from pyspark.sql import Window

    s = stories(spark, sf_dir)
    ranks = s.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("Rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "Symbol")).cast("long"))
    return news.news_feed(s, ranks)


@register("news_upsert", f"with {NEWS}, o as (select id::varchar as Cluster_Key, Published as First_Seen, Symbol from nw where id % 2 = 0), n as (select id::varchar as Cluster_Key, Published - 5 as First_Seen, case when id % 4 = 0 then 'new' end as Symbol from nw where id % 3 = 0) select Cluster_Key, least(o.First_Seen, n.First_Seen) as First_Seen, coalesce(n.Symbol, o.Symbol) as Symbol from o full join n using (Cluster_Key)")
def news_upsert(spark, sf_dir):
    s = stories(spark, sf_dir)
    key = F.col("id").cast("string").alias("Cluster_Key")
    old = s.where("id % 2 = 0").select(key, F.col("Published").alias("First_Seen"), "Symbol")
    new = s.where("id % 3 = 0").select(key, F.date_sub("Published", 5).alias("First_Seen"), F.when(F.col("id") % 4 == 0, "new").alias("Symbol"))
    return news.news_upsert(old, new)


@register("source_status", "with r as (select 'S' || user_id as Source, event_id as Run, event_type != 'error' as ok from events) select Source, count(*) as Runs, count(*) filter (ok) as OK, max(case when ok then Run end) as Last_Success, case when count(*) = count(*) filter (ok) then 'success' when count(*) filter (ok) > 0 then 'partial' else 'failed' end as Status from r group by 1")
def source_status(spark, sf_dir):
    e = panel.table(spark, sf_dir, "events")
    return news.source_status(e.select(panel.symbol("user_id").alias("Source"), F.col("event_id").alias("Run"), (F.col("event_type") != "error").alias("ok")))


_LEX = ", ".join(f"('{t}', {p}::double)" for t, p in LEXICON)
_SENT = f"lex(term, polarity) as (values {_LEX}), tk as (select doc_id, source as Symbol, date '{AS_OF}' - (doc_id % 30)::int as Day, unnest(string_split({_TITLE.format('text')}, ' ')) as term from documents), sm as (select doc_id, Symbol, Day, greatest(least(sum(polarity) / sqrt(count(*)) / 3, 1.0::double), -1.0::double) as polarity from tk join lex using (term) group by 1, 2, 3)"


def _scored(spark, sf_dir):
    lexicon = spark.createDataFrame(list(LEXICON), "term string, polarity double")
    scores = news.lexicon_sentiment(panel.headlines(spark, sf_dir), lexicon)
    return scores.join(panel.headlines(spark, sf_dir).select("doc_id", "Symbol").hint("shuffle_hash"), "doc_id").withColumn("Day", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 30).cast("int")))


@register("sentiment_by_symbol", f"with {_SENT}, d as (select Symbol, Day, count(*) as n, count(*) filter (polarity > 0.05) as p, count(*) filter (polarity < -0.05) as m, sum(polarity) as s from sm group by 1, 2), w as (select Symbol, Day, sum(n) over w as n, sum(p) over w as p, sum(m) over w as m, sum(s) over w as s from d window w as (partition by Symbol order by Day range between interval 6 day preceding and current row)) select Symbol, Day, n::bigint as Headlines, {sql.r4x('p / n::double')} as Pos_Share, {sql.r4x('m / n::double')} as Neg_Share, {sql.r4x('s / n')} as Mean from w")
def sentiment_by_symbol(spark, sf_dir):
    return news.sentiment_by_symbol(_scored(spark, sf_dir)).select("Symbol", "Day", "Headlines", *r4("Pos_Share", "Neg_Share", "Mean"))


@register("sentiment_veto", f"with {_SENT}, v as (select Symbol || '-' || (doc_id % 9) as Symbol, count(*) as Headlines, avg(case when polarity < -0.05 then 1.0::double else 0.0 end) as Neg_Share from sm group by 1) select Symbol, Headlines, {sql.r4('Neg_Share')} from v where Headlines >= 3 and round(Neg_Share, 10) >= 0.6")
def sentiment_veto(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("Symbol", F.concat("Symbol", F.lit("-"), F.col("doc_id") % 9))
    return news.sentiment_veto(s).select("Symbol", "Headlines", *r4("Neg_Share"))


_AL = "al as (select p_partkey, 'P' || p_partkey as Symbol, string_split(p_name, ' ')[-1] || ' unit' || p_partkey || case p_partkey % 4 when 0 then ' Limited' when 1 then ' Industries Ltd.' when 2 then ' Bank' else '' end as Name from part)"
#: Aliases of the overrides: some of one word, some generic, some shared by many.
_EXTRA = "x as (select 'P' || p_partkey as Symbol, list_sort(list_distinct(['Alias ' || p_partkey, 'maker' || (p_partkey // 7), 'Bank', p_brand || ' No. ' || p_partkey])) as x from part where p_partkey % 3 = 0)"
_WORDS = "list_filter(string_split(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w != '')"
_GENERIC = ", ".join(f"'{w}'" for w in rel.GENERIC)
_DISTINCT = "list_filter({}, lambda w: length(w) >= 4 and not list_contains([" + _GENERIC + "], w))"
_ALIASES = f"""{_AL}, {_EXTRA}, sh as (select Symbol, Name, trim(regexp_replace(regexp_replace(Name, '(?i){rel.LEGAL}', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')) as s from al),
own as (select Symbol, list_filter([Symbol, trim(Name), case when s != '' and lower(s) != lower(trim(Name)) and (len({_DISTINCT.format(_WORDS.format('s'))}) >= 2 or (len(string_split(s, ' ')) = 1 and not list_contains([{_GENERIC}], lower(s)))) then s end], lambda a: a is not null and a != '') as o from sh),
ea as (select Symbol, unnest(list_concat(o, coalesce(x, []))) as alias, generate_subscripts(list_concat(o, coalesce(x, [])), 1) as i from own left join x using (Symbol)),
aliases as (select Symbol, alias, row_number() over (partition by Symbol order by i) - 1 as rank from (select *, row_number() over (partition by Symbol, lower(alias) order by i) as copy from ea) where copy = 1)"""


def _candidates(spark, sf_dir):
    """(Symbol, Aliases) of the parts by name, number and a suffix, a third with overrides."""
    p, k = panel.table(spark, sf_dir, "part"), F.col("p_partkey")
    end = F.when(k % 4 == 0, " Limited").when(k % 4 == 1, " Industries Ltd.").when(k % 4 == 2, " Bank").otherwise("")
    master = p.select(F.concat(F.lit("P"), k).alias("Symbol"), F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(" unit"), k, end).alias("Name"))
    extra = F.explode(F.array(F.concat(F.lit("Alias "), k), F.concat(F.lit("maker"), F.floor(k / 7).cast("long")), F.lit("Bank"), F.concat("p_brand", F.lit(" No. "), k)))
    return rel.build_aliases(master, p.where("p_partkey % 3 = 0").select(F.concat(F.lit("P"), k).alias("Symbol"), extra.alias("Alias")))


@register("build_aliases", f"with {_ALIASES} select Symbol, string_agg(alias, '|' order by rank) as Aliases from aliases group by 1")
def build_aliases(spark, sf_dir):
    return _candidates(spark, sf_dir).select("Symbol", F.array_join("Aliases", "|").alias("Aliases"))


_STORY = """st as (select c_custkey as id, c_custkey % 7 = 6 as filing, case when c_custkey % 2 = 0 then ' p' || c_custkey else 'P' || (c_custkey + 1) end as filing_symbol,
  case c_custkey % 7 when 0 then 'about p' || (c_custkey + 1) || ' today' when 1 then 'The ' || Name || ' rises' when 2 then 'Up: ' || array_to_string(list_reverse(string_split(Name, ' ')), ' ') when 3 then replace(Name, ' ', ', ') || '?'
  when 4 then 'Orders for maker' || c_custkey || '_x and Maker' || (c_custkey // 7) when 5 then 'Alias ' || c_custkey || chr(9) || ' ' || c_mktsegment || ' of ' || upper(Name) else 'P' || c_custkey end as title from customer left join al on c_custkey = p_partkey)"""


def _stories(spark, sf_dir):
    """Titles that hold symbols, names in order, reversed or parted by commas, aliases of one word, and filings."""
    k = F.col("c_custkey")
    p = panel.table(spark, sf_dir, "part")
    q = F.col("p_partkey")
    end = F.when(q % 4 == 0, " Limited").when(q % 4 == 1, " Industries Ltd.").when(q % 4 == 2, " Bank").otherwise("")
    named = p.select(q.alias("c_custkey"), F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(" unit"), q, end).alias("Name"))
    c = panel.table(spark, sf_dir, "customer").join(named.hint("merge"), "c_custkey", "left")
    lit, kind = F.lit, k % 7
    title = F.when(kind == 0, F.concat(lit("about p"), k + 1, lit(" today"))).when(kind == 1, F.concat(lit("The "), "Name", lit(" rises"))).when(kind == 2, F.concat(lit("Up: "), F.array_join(F.reverse(F.split("Name", " ")), " ")))
    title = title.when(kind == 3, F.concat(F.replace("Name", lit(" "), lit(", ")), lit("?"))).when(kind == 4, F.concat(lit("Orders for maker"), k, lit("_x and Maker"), F.floor(k / 7).cast("long")))
    title = title.when(kind == 5, F.concat(lit("Alias "), k, lit("\t "), "c_mktsegment", lit(" of "), F.upper("Name"))).otherwise(F.concat(lit("P"), k))
    filed = F.when(k % 2 == 0, F.concat(lit(" p"), k)).otherwise(F.concat(lit("P"), k + 1))
    return c.select(k.alias("id"), title.alias("title"), (kind == 6).alias("filing"), filed.alias("filing_symbol"))


@register("relevance", f"""with {_ALIASES}, {_STORY},
n as materialized (select *, ' ' || trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ; ', 'g'), '\\s+', ' ', 'g')) || ' ' as t from st),
w as materialized (select Symbol, rank, ws, array_to_string(ws, ' ') as phrase, {_DISTINCT.format('ws')} as ds from (select *, {_WORDS.format('alias')} as ws from aliases where lower(alias) != lower(Symbol))),
found as (select id, Symbol, -2 as rank, 'Official filing mapping' as reason from n join al on upper(trim(filing_symbol)) = upper(Symbol) where filing
union all select id, Symbol, -1, 'Symbol match' from n join al on contains(t, ' ' || lower(Symbol) || ' ') where not filing
union all select id, Symbol, rank, case when contains(t, ' ' || phrase || ' ') then 'Exact alias match' else 'Token alias match' end from n join w on
  (contains(t, ' ' || phrase || ' ') and (len(ws) > 1 or len(ds) = 1)) or (len(ws) > 1 and len(list_filter(ds, lambda d: contains(t, ' ' || d || ' '))) >= 2) where not filing)
select id, Symbol, arg_min(reason, rank) as Reason from found group by 1, 2""")
def relevance(spark, sf_dir):
    return rel.relevance(_stories(spark, sf_dir), _candidates(spark, sf_dir), table)


@register("news_dedup")
def news_dedup(spark, sf_dir):
    return clusters.news_dedup(stories(spark, sf_dir), table)


@register("news_clusters")
def news_clusters(spark, sf_dir):
    """Merged rows; a story's source is its page's host, and it is first seen some days after it was published."""
    s = stories(spark, sf_dir).withColumn("Source", F.regexp_extract("url", "://([^/]*)", 1)).withColumn("First_Seen", F.date_add("Published", (F.col("id") % 11).cast("int")))
    return clusters.merged(s.drop("title"), clusters.news_dedup(s, table)).select("leader", "id", "Symbol", "filing", "First_Seen", "Published", "All_Sources", "Duplicate_Count")
