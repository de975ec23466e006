"""Registered queries of the universe and fund metadata; parts stand in for schemes, customers for listed funds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import metadata, names
from barlake.plans import sql
from barlake.plans.queries import r4, register, table

AS_OF = "2024-03-01"


def _has(words) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


_NAME = "upper(p_name || ' ' || p_type || case p_partkey % 6 when 0 then ' Gold' when 1 then ' Liquid' when 2 then ' Bank' when 3 then ' Nifty Next 50' when 4 then ' NASDAQ 100' else '' end)"
_CAT = "case " + " ".join(f"when {_has(words)} then '{label}'" for label, words in metadata.CATEGORIES) + " else 'ETF' end"


@register("classify_etf", f"""with p as (select p_partkey, {_NAME} as t, p_partkey % 4 != 0 as etf from part), c as (select *, {_CAT} as c from p)
select p_partkey, case when etf then c end as ETF_Category, case when not etf then 'Stock' when c = 'Parking/Debt ETF' then 'Parking/Debt ETF' when c in ('Gold ETF', 'Silver ETF') then 'Commodity ETF' when c = 'International ETF' then 'International ETF' else 'Equity ETF' end as Opportunity_Type,
  case when etf and {_has(metadata.PARKING)} then 'No' else 'Yes' end as Opportunity_Eligible from c""")
def classify_etf(spark, sf_dir):
    p = panel.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    extra = F.when(k % 6 == 0, " Gold").when(k % 6 == 1, " Liquid").when(k % 6 == 2, " Bank").when(k % 6 == 3, " Nifty Next 50").when(k % 6 == 4, " NASDAQ 100").otherwise("")
    df = p.select(k, F.concat("p_name", F.lit(" "), "p_type", extra).alias("Name"), F.when(k % 4 == 0, "Stock").otherwise("ETF").alias("Universe"))
    return metadata.classify_etf(df).select("p_partkey", "ETF_Category", "Opportunity_Type", "Opportunity_Eligible")


_SYM = "case c_custkey % 11 when 0 then ' ' when 1 then 'dummy' || c_custkey when 2 then 'TEST' || c_custkey when 3 then c_mktsegment || '.ns' else ' c' || c_custkey || ' ' end"
_CLEAN = "case when upper(trim(s)) = '' then null when ends_with(upper(trim(s)), '.NS') then upper(trim(s)) else upper(trim(s)) || '.NS' end"
_BAD = "(upper(trim(s)) = '' or starts_with(upper(trim(s)), 'DUMMY') or starts_with(upper(trim(s)), 'TEST'))"


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    s = F.when(k % 11 == 0, " ").when(k % 11 == 1, F.concat(F.lit("dummy"), k)).when(k % 11 == 2, F.concat(F.lit("TEST"), k)).when(k % 11 == 3, F.concat("c_mktsegment", F.lit(".ns"))).otherwise(F.concat(F.lit(" c"), k, F.lit(" ")))
    return panel.table(spark, sf_dir, "customer").withColumn("Symbol", s)


@register("clean_symbol", f"with c as (select c_custkey, {_SYM} as s from customer) select c_custkey, {_CLEAN} as Symbol, {_BAD} as Bad from c")
def clean_symbol(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", metadata.clean_symbol(F.col("Symbol")).alias("Symbol"), metadata.bad_symbol(F.col("Symbol")).alias("Bad"))


@register("load_master", f"with c as (select c_custkey, {_SYM} as s, case c_custkey % 5 when 0 then 'No' when 1 then ' Yes' when 2 then 'TRUE' when 3 then null else '1' end as i, trim(c_name) as Name from customer), k as (select *, trim(s) as Symbol, row_number() over (partition by trim(s) order by c_custkey) as k from c where lower(trim(coalesce(i, 'yes'))) in ('yes', 'y', 'true', '1') and trim(s) != '') select Symbol, c_custkey, Name from k where k = 1")
def load_master(spark, sf_dir):
    k = F.col("c_custkey") % 5
    include = F.when(k == 0, "No").when(k == 1, " Yes").when(k == 2, "TRUE").when(k == 3, None).otherwise("1")
    df = _customers(spark, sf_dir).select("Symbol", "c_custkey", F.col("c_name").alias("Name"), include.alias("Include"))
    return metadata.load_master(df, ["c_custkey"]).select("Symbol", "c_custkey", "Name")


@register("universe_union_priority", f"""with c as (select *, {_SYM} as s from customer), u as (select s, c_mktsegment as g, 1 as p from c where c_custkey % 3 = 0 union all select s, 'second', 2 from c where c_custkey % 2 = 0 union all select s, 'all', 3 from c),
k as (select {_CLEAN} as Symbol, g, p from u where not {_BAD}), m as (select *, row_number() over (partition by Symbol order by p, g) as k from k) select Symbol, g as Universe_Group, p::bigint as Priority from m where k = 1""")
def universe_union_priority(spark, sf_dir):
    c = _customers(spark, sf_dir)
    lists = [c.where("c_custkey % 3 = 0").select("Symbol", F.col("c_mktsegment").alias("Universe_Group")), c.where("c_custkey % 2 = 0").select("Symbol", F.lit("second").alias("Universe_Group")), c.select("Symbol", F.lit("all").alias("Universe_Group"))]
    return metadata.universe_union_priority(lists)


@register("alias_columns", "select p_partkey, p_name as Name, p_brand as Brand, case when p_size % 2 = 0 then p_type end as Kind, null::varchar as Absent from part")
def alias_columns(spark, sf_dir):
    from barlake.sources.readers import aliased

    p = panel.table(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.col("p_name").alias("Scheme NAME"), F.col("p_brand").alias("brand-code"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).alias("kind"), F.when(F.col("p_size") % 4 == 2, F.col("p_type")).alias("Type."))
    return aliased(raw, {"p_partkey": (), "Name": ("scheme_name",), "Brand": ("brandcode",), "Kind": ("type",), "Absent": ("nothing",)})


def _amounts(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.format_number("p_retailprice", 2)
    text = F.when(k % 4 == 0, F.concat(F.lit("Rs. "), value, F.lit(" Cr"))).when(k % 4 == 1, F.concat(value, F.lit(" lakh"))).when(k % 4 == 2, F.concat(F.lit("INR "), value, F.lit(" million"))).otherwise("n/a")
    share = F.when(k % 3 == 0, F.concat(F.format_number(F.col("p_size") / 10, 1), F.lit(" %"))).when(k % 3 == 1, F.format_number(F.col("p_size") / 1000, 3)).otherwise(F.format_number(F.col("p_size") / 10, 1))
    return panel.table(spark, sf_dir, "part").select(k, text.alias("amount"), share.alias("share"))


_AMOUNT = "case p_partkey % 4 when 0 then round(p_retailprice, 2) when 1 then round(p_retailprice, 2) / 100 when 2 then round(p_retailprice, 2) / 10 end"
_SHARE = "case p_partkey % 3 when 0 then round(p_size / 10.0, 1) / 100 when 1 then round(p_size / 1000.0, 3) else round(p_size / 10.0, 1) / 100 end::double"


@register("parse_amounts", f"with a as (select p_partkey, {_AMOUNT} as a, {_SHARE} as s from part) select p_partkey, {sql.r4x('a')} as Amount_Cr, {sql.r4x('s')} as Share from a")
def parse_amounts(spark, sf_dir):
    df = _amounts(spark, sf_dir).select("p_partkey", metadata.parse_amount(F.col("amount")).alias("Amount_Cr"), metadata.parse_percent(F.col("share")).alias("Share"))
    return df.select("p_partkey", *r4("Amount_Cr", "Share"))


_FUNDS = f"""funds as (select s_suppkey as k, 'S' || s_suppkey as Symbol, s_name as Name, case when s_suppkey % 13 = 0 then s_suppkey::double when s_suppkey % 7 != 0 then round(s_acctbal / 20, 4) end as AUM_Cr, case when s_suppkey % 3 != 0 then (s_suppkey % 13) / 200.0::double end as TER, case when s_suppkey % 6 != 0 then (s_suppkey % 9) / 20.0::double - 0.1 end as Tracking_Error,
  case when s_suppkey % 8 != 0 then (s_suppkey % 10 - 5) / 20.0::double end as Tracking_Difference, case when s_suppkey % 5 != 0 then 10.0::double end as NAV, case s_suppkey % 4 when 0 then '' when 1 then null else 'Nifty' end as Benchmark_Index, s_suppkey::varchar as Scheme_Code,
  case when s_suppkey % 9 != 0 then date '{AS_OF}' - (s_suppkey % 20)::int end as NAV_Date, ['Verified', 'Suggested', 'Review', 'Missing'][s_suppkey % 4 + 1] as Mapping_Status from supplier),
chk as (select *, case when AUM_Cr is null then 'missing' when AUM_Cr <= 0 then 'blank_or_non_positive' when AUM_Cr = Scheme_Code::double then 'scheme_code_like' when AUM_Cr > 100000 then 'too_large' else 'ok' end as a, case when TER is null then 'missing' when TER <= 0 then 'blank_or_non_positive' when TER > 0.05 then 'too_large' else 'ok' end as t,
  case when Tracking_Error is null then 'missing' when Tracking_Error < 0 then 'negative' when Tracking_Error > 0.2 then 'too_large' else 'ok' end as e, case when Tracking_Difference is null then 'missing' when abs(Tracking_Difference) > 0.2 then 'too_large' else 'ok' end as d, trim(coalesce(Benchmark_Index, '')) != '' as b from funds)"""


def funds(spark, sf_dir):
    """Suppliers as funds with metadata full of gaps and mistakes."""
    k = F.col("s_suppkey")
    return panel.table(spark, sf_dir, "supplier").select(
        k.alias("k"), panel.symbol("s_suppkey").alias("Symbol"), F.col("s_name").alias("Name"), F.when(k % 13 == 0, k.cast("double")).when(k % 7 != 0, F.round(F.col("s_acctbal") / 20, 4)).alias("AUM_Cr"),
        F.when(k % 3 != 0, (k % 13) / F.lit(200.0)).alias("TER"), F.when(k % 6 != 0, (k % 9) / F.lit(20.0) - 0.1).alias("Tracking_Error"), F.when(k % 8 != 0, (k % 10 - 5) / F.lit(20.0)).alias("Tracking_Difference"),
        F.when(k % 5 != 0, 10.0).alias("NAV"), F.when(k % 4 == 0, "").when(k % 4 == 1, None).otherwise("Nifty").alias("Benchmark_Index"), k.cast("string").alias("Scheme_Code"),
        F.when(k % 9 != 0, F.date_sub(F.lit(AS_OF).cast("date"), (k % 20).cast("int"))).alias("NAV_Date"), F.element_at(F.array(*map(F.lit, ("Verified", "Suggested", "Review", "Missing"))), (k % 4 + 1).cast("int")).alias("Mapping_Status"),
    )


@register("validate_metadata", f"with {_FUNDS} select Symbol, a as AUM_Reason, t as TER_Reason, e as TE_Reason, d as TD_Reason, {sql.r4x(chr(99) + 'ase when a = ' + chr(39) + 'ok' + chr(39) + ' then AUM_Cr end')} as AUM_Value from chk")
def validate_metadata(spark, sf_dir):
    v = metadata.validate_metadata(funds(spark, sf_dir))
    return v.select("Symbol", F.col("AUM_Check.reason").alias("AUM_Reason"), F.col("TER_Check.reason").alias("TER_Reason"), F.col("TE_Check.reason").alias("TE_Reason"), F.col("TD_Check.reason").alias("TD_Reason"), F.col("AUM_Check.value").alias("AUM_Value")).withColumn("AUM_Value", F.round(F.col("AUM_Value") + sql.NUDGE, 4))


@register("metadata_confidence", f"""with {_FUNDS}, f as (select *, concat_ws('; ', case when NAV is null then 'NAV missing' end, case when a != 'ok' then 'AUM invalid' end, case when t != 'ok' then 'TER invalid' end, case when e != 'ok' and d != 'ok' and not (NAV is not null and a = 'ok' and t = 'ok' and b) then 'Tracking quality metric missing' end, case when not b then 'Benchmark missing' end) as f from chk)
select Symbol, round((case when NAV is not null then 0.3 else 0 end) + (case when a = 'ok' then 0.25 else 0 end) + (case when t = 'ok' then 0.15 else 0 end) + (case when e = 'ok' then 0.15 when d = 'ok' then 0.1 else 0 end) + (case when b then 0.15 else 0 end), 4)::double as Metadata_Confidence, case when f = '' then 'Complete' else f end as Metadata_Flags from f""")
def metadata_confidence(spark, sf_dir):
    return metadata.metadata_confidence(metadata.validate_metadata(funds(spark, sf_dir))).select("Symbol", "Metadata_Confidence", "Metadata_Flags")


@register("dq_flags", f"""with {_FUNDS}, d as (select *, len(list_filter(generate_series(NAV_Date + 1, date '{AS_OF}', interval 1 day), lambda x: isodow(x) < 6)) as n from funds), f as (select Symbol, concat_ws('|', case when lower(Mapping_Status) not in ('verified', 'manual', 'matched') then 'UNRESOLVED_MAPPING' end, case when TER is null then 'MISSING_TER' end, case when Tracking_Error is null and Tracking_Difference is null then 'MISSING_TRACKING' end,
  case when NAV_Date is null or n > 5 then 'STALE_NAV' end, case when AUM_Cr < 25 then 'LOW_AUM' end) as f from d) select Symbol, case when f = '' then 'OK' else f end as Quality_Flags from f""")
def dq_flags(spark, sf_dir):
    return metadata.dq_flags(funds(spark, sf_dir), AS_OF).select("Symbol", "Quality_Flags")


_FIELDS = ("NAV", "TER", "AUM_Cr", "Benchmark_Index", "Tracking_Error", "Tracking_Difference")


@register("fill_rates", f"with {_FUNDS} " + " union all ".join(f"select '{c}' as Field, round(avg(case when {c} is not null and trim({c}::varchar) != '' then 1.0::double else 0.0 end), 6) as Fill_Rate from funds" for c in _FIELDS))
def fill_rates(spark, sf_dir):
    return metadata.fill_rates(funds(spark, sf_dir), list(_FIELDS)).select("Field", F.round("Fill_Rate", 6).alias("Fill_Rate"))


@register("dq_health_score", f"with {_FUNDS} select count(*) as Rows, round(100 * ({' + '.join(f'avg(case when {c} is not null and trim({c}::varchar) != {chr(39)}{chr(39)} then 1.0::double else 0.0 end) * {w}' for c, w in metadata.HEALTH.items())}) / {sum(metadata.HEALTH.values())}, 1) as Health_Score from funds")
def dq_health_score(spark, sf_dir):
    return metadata.dq_health_score(funds(spark, sf_dir))


def _names(spark, sf_dir):
    p, k = panel.table(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string").alias("ISIN")
    left = p.select(F.concat(F.lit("P"), k).alias("Symbol"), k.cast("string").alias("Code"), none, F.concat_ws(" ", "p_brand", "p_size", F.lit("ETF")).alias("Name"))
    right = p.select(k.alias("Id"), F.when(k % 3 == 0, F.concat(F.lit("P"), k)).alias("Symbol"), F.when(k % 3 == 1, k.cast("string")).alias("Code"), none, F.concat("p_brand", F.lit("  "), F.col("p_size") + k % 2, F.lit(" Fund")).alias("Name"))
    return left, right


@register("fuzzy_name_match")
def fuzzy_name_match(spark, sf_dir):
    left, right = _names(spark, sf_dir)
    return names.fuzzy_name_match(left, right, table)


@register("id_match_cascade")
def id_match_cascade(spark, sf_dir):
    return names.id_match_cascade(*_names(spark, sf_dir), table)


def _sources(spark, sf_dir):
    f = funds(spark, sf_dir)
    part = lambda name, p, every: f.where(F.col("k") % every == 0).select("Symbol", F.lit(name).alias("Source"), F.lit(p).alias("Priority"), F.when(F.col("k") % 7 != p, F.col("TER") + p).alias("TER"), F.when(F.col("k") % 5 != p, F.col("AUM_Cr") + p).alias("AUM_Cr"))
    return part("amfi", 1, 1).unionByName(part("nse", 2, 2)).unionByName(part("sebi", 3, 3))


_SRC = f"""{_FUNDS}, src as ({' union all '.join(f"select Symbol, '{n}' as Source, {p} as Priority, case when k % 7 != {p} then TER + {p} end as TER, case when k % 5 != {p} then AUM_Cr + {p} end as AUM_Cr from funds where k % {e} = 0" for n, p, e in (('amfi', 1, 1), ('nse', 2, 2), ('sebi', 3, 3)))})"""


@register("coalesce_metadata", f"""with {_SRC}, a as (select Symbol, arg_min(TER, Priority) filter (TER is not null) as TER, arg_min(AUM_Cr, Priority) filter (AUM_Cr is not null) as AUM_Cr, array_to_string(list_sort(list_distinct(list(Source) filter (TER is not null or AUM_Cr is not null))), '+') as Sources from src group by 1), m as (select Symbol, 0.5::double as TER from funds where k % 10 = 0)
select Symbol, {sql.r4x('coalesce(m.TER, a.TER)')} as TER, {sql.r4('AUM_Cr')}, coalesce(Sources, '') as Sources from a full join m using (Symbol)""")
def coalesce_metadata(spark, sf_dir):
    manual = funds(spark, sf_dir).where("k % 10 = 0").select("Symbol", F.lit(0.5).alias("TER"), F.lit(None).cast("double").alias("AUM_Cr"))
    return metadata.coalesce_metadata(_sources(spark, sf_dir), manual, ["TER", "AUM_Cr"]).select("Symbol", *r4("TER", "AUM_Cr"), "Sources")


@register("source_cascade", f"with {_SRC}, k as (select *, row_number() over (partition by Symbol order by TER is null, Priority) as k, count(*) over (partition by Symbol) as n from src) select Symbol, 'TER' as Metric, {sql.r4x('TER')} as Value, case when TER is not null then Source end as Source, n as Tried from k where k = 1")
def source_cascade(spark, sf_dir):
    s = _sources(spark, sf_dir).select("Symbol", F.lit("TER").alias("Metric"), "Source", "Priority", F.col("TER").alias("Value"))
    return metadata.source_cascade(s).select("Symbol", "Metric", *r4("Value"), "Source", "Tried")


@register("etf_quality_build", f"""with {_FUNDS}, m as (select Symbol, case when Mapping_Status in ('Verified', 'Suggested') then k end as Id from funds), j as (select m.Symbol, NAV, AUM_Cr, TER, Tracking_Error, Tracking_Difference from m left join funds f on f.k = m.Id),
f as (select Symbol, concat_ws('; ', case when NAV is null then 'NAV missing' end, case when AUM_Cr is null then 'AUM missing' end, case when TER is null then 'TER missing' end, case when Tracking_Error is null and Tracking_Difference is null then 'Tracking quality metric missing' when Tracking_Error is null then 'Tracking error unavailable; tracking difference available' end) as f from j) select Symbol, case when f = '' then 'Complete' else f end as ETF_Quality_Data_Flag from f""")
def etf_quality_build(spark, sf_dir):
    f = funds(spark, sf_dir)
    data = f.select(F.col("k").alias("Id"), "NAV", "AUM_Cr", "TER", "Tracking_Error", "Tracking_Difference")
    return metadata.etf_quality_build(f, f.select("Symbol", F.col("k").alias("Id"), "Mapping_Status"), data).select("Symbol", "ETF_Quality_Data_Flag")


@register("pick_value_column", "select 'Average AUM' as column_name, count(*) as n from part")
def pick_value_column(spark, sf_dir):
    p = panel.table(spark, sf_dir, "part")
    raw = p.select(F.col("p_partkey").alias("code"), F.col("p_partkey").alias("AUM code"), F.format_number("p_retailprice", 2).alias("Average AUM"), F.col("p_name").alias("text"))
    return raw.agg(F.lit(metadata.pick_value_column(raw, "aum", "code")).alias("column_name"), F.count(F.lit(1)).alias("n"))


@register("standardize_imports", f"with a as (select p_partkey, {_AMOUNT} as a, {_SHARE} as s from part), v as (select *, case when a is null then 'missing' when a <= 0 then 'blank_or_non_positive' when a = p_partkey then 'scheme_code_like' when a > 100000 then 'too_large' else 'ok' end as ar, case when s is null then 'missing' when s <= 0 then 'blank_or_non_positive' when s > 0.05 then 'too_large' else 'ok' end as sr from a) select p_partkey::varchar as Import_Code, {sql.r4x(chr(99) + 'ase when ar = ' + chr(39) + 'ok' + chr(39) + ' then a end')} as Import_AUM_Cr, 'aum:' || ar || '; ter:' || sr as Import_Reason, 'parts' as Import_Source from v")
def standardize_imports(spark, sf_dir):
    raw = _amounts(spark, sf_dir).select(F.col("p_partkey").alias("AMFI Code"), F.col("amount").alias("Average AUM"), F.col("share").alias("Expense Ratio"))
    return metadata.standardize_imports(raw, "parts").select("Import_Code", *r4("Import_AUM_Cr"), "Import_Reason", "Import_Source")


@register("combine_sources", "select distinct p_brand as Code, case when p_size % 2 = 0 then p_type end as Kind, null::varchar as Note from part union select distinct p_brand, null, 'x' from part where p_size > 10")
def combine_sources(spark, sf_dir):
    p = panel.table(spark, sf_dir, "part")
    a = p.select(F.col("p_brand").alias("Code"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ").alias("Kind"))
    b = p.where("p_size > 10").select(F.concat(F.col("p_brand"), F.lit(" ")).alias("Code"), F.lit("x").alias("Note"))
    return metadata.combine_sources([a, b, p.select(F.lit("").alias("Code"))], ["Code"]).select("Code", "Kind", "Note")


@register("manual_template", f"with {_FUNDS} select Symbol, Name, case when Mapping_Status = 'Suggested' then k end as Id, null::varchar as Manual_AUM_Cr, null::varchar as Manual_TER, null::varchar as Notes from funds")
def manual_template(spark, sf_dir):
    f = funds(spark, sf_dir)
    return metadata.manual_template(f, f.where("Mapping_Status = 'Suggested'").select("Symbol", F.col("k").alias("Id")))


@register("etf_subset", f"with {sql.MASTER} select Symbol, coalesce(Name, Symbol) as Name, Sector from master where Universe = 'ETF'")
def etf_subset(spark, sf_dir):
    return metadata.etf_subset(panel.master(spark, sf_dir))
