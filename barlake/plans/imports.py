"""Registered queries of import tables; parts stand in for schemes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import imports
from barlake.plans import sql
from barlake.plans.queries import r4, register


@register("standard_base_columns", "select p_partkey::varchar as Scheme_Code, 'IN' || p_partkey as ISIN, trim(p_brand || ' ETF Fund ' || p_name) as Scheme_Name, 'Nifty ' || p_size || ' TRI Index' as Benchmark_Index from part")
def standard_base_columns(spark, sf_dir):
    """Code and ISIN by header, name and benchmark by their values."""
    p = panel.table(spark, sf_dir, "part")
    raw = p.select(
        F.col("p_partkey").alias("AMFI  Code"), F.concat(F.lit(" IN"), "p_partkey").alias("ISIN No."), F.col("p_type").alias("Kind"),
        F.concat(F.lit("Nifty "), "p_size", F.lit(" TRI Index")).alias("Tracks"), F.concat_ws(" ", "p_brand", F.lit("ETF Fund"), "p_name").alias("Plan"), F.col("p_retailprice").alias("Price"),
    )
    return imports.standard_base_columns(raw)


_PIECES = "pieces as (select 'S' || p_partkey % 700 as Symbol, 0 as f, p_partkey as k, p_partkey::varchar as AMFI_Scheme_Code, p_name as AMFI_Scheme_Name, null::varchar as ISIN from part where p_partkey % 5 != 0 union all select 'S' || p_partkey % 700, 1, p_partkey, p_partkey::varchar, null, 'IN' || p_partkey from part where p_partkey % 4 = 0)"
_CONTEXT = f"{_PIECES}, context as (select * exclude (n) from (select *, row_number() over (partition by Symbol order by f desc, k desc) as n from pieces) where n = 1)"


def _context(spark, sf_dir):
    p, k = panel.table(spark, sf_dir, "part"), F.col("p_partkey")
    symbol, code = F.concat(F.lit("S"), k % 700).alias("Symbol"), k.cast("string").alias("AMFI_Scheme_Code")
    enriched = p.where(k % 5 != 0).select(symbol, k.alias("k"), code, F.col("p_name").alias("AMFI_Scheme_Name"))
    manual = p.where(k % 4 == 0).select(symbol, k.alias("k"), code, F.concat(F.lit("IN"), k).alias("ISIN"))
    return imports.mapping_context([enriched, manual], "k")


@register("mapping_context", f"with {_CONTEXT} select Symbol, AMFI_Scheme_Code, AMFI_Scheme_Name, ISIN from context")
def mapping_context(spark, sf_dir):
    return _context(spark, sf_dir).select("Symbol", "AMFI_Scheme_Code", "AMFI_Scheme_Name", "ISIN")


@register("nav_mappings", """with n as (select p_partkey as k, (p_partkey % 900)::varchar as Scheme_Code, case when p_partkey % 3 = 0 then ' ' else p_name end as Scheme_Name, 'IN' || p_partkey % 1100 as a, case when p_partkey % 2 = 0 then '-' else 'in' || p_partkey end as b from part),
i as (select upper(a) as ISIN, Scheme_Code, k from n union all select upper(b), Scheme_Code, k from n where b != '-'), c as (select ISIN, arg_max(Scheme_Code, k) as Scheme_Code from i group by 1), m as (select Scheme_Code, arg_max(trim(Scheme_Name), k) as Scheme_Name from n where trim(Scheme_Name) != '' group by 1) select ISIN, Scheme_Code, Scheme_Name from c left join m using (Scheme_Code)""")
def nav_mappings(spark, sf_dir):
    p, k = panel.table(spark, sf_dir, "part"), F.col("p_partkey")
    nav = p.select(k.alias("k"), (k % 900).alias("Scheme_Code"), F.when(k % 3 == 0, " ").otherwise(F.col("p_name")).alias("Scheme_Name"), F.concat(F.lit("IN"), k % 1100).alias("ISIN Growth"), F.when(k % 2 == 0, "-").otherwise(F.concat(F.lit("in"), k)).alias("ISIN Payout"))
    codes, names = imports.nav_mappings(nav, ["ISIN Growth", "ISIN Payout"], "k")
    return codes.join(names.hint("shuffle_hash"), "Scheme_Code", "left").select("ISIN", "Scheme_Code", "Scheme_Name")


_FUNDS = "e as (select 'S' || p_partkey % 700 as Symbol, case when min(p_partkey) % 3 = 0 then 'OWN' || min(p_partkey) end as ISIN, min(p_brand) as Name from part group by 1)"


@register("import_output", f"""with {_CONTEXT}, {_FUNDS}, m as (select context.Symbol, 'code' as Match_Method, 1.0::double as Match_Score, 'parts' as Source, p_name as Scheme_Name, case when p_size % 3 != 0 then p_size / 1000.0::double end as TER, case when p_size % 2 = 0 then p_size / 500.0::double end as Tracking_Error, case when p_size % 5 = 0 then ' ' else p_type end as Benchmark_Index from context join part on p_partkey::varchar = AMFI_Scheme_Code where p_partkey % 6 != 0)
select e.Symbol, e.Symbol as NSE_Symbol, coalesce(e.ISIN, c.ISIN, '') as ISIN, coalesce(c.AMFI_Scheme_Code, '') as AMFI_Scheme_Code, case when c.Symbol is null then coalesce(m.Scheme_Name, Name) else coalesce(nullif(trim(c.AMFI_Scheme_Name), ''), Name) end as Scheme_Name, {sql.r4x('TER')} as TER, {sql.r4x('Tracking_Error')} as Tracking_Error, null::double as Tracking_Difference,
coalesce(trim(Benchmark_Index), '') as Benchmark_Index, coalesce(Match_Method, 'unmatched') as Match_Method, coalesce(Match_Score, 0.0::double) as Match_Score, coalesce(Source, '') as Source, TER is not null as TER_Filled, Tracking_Error is not null as Tracking_Error_Filled, false as Tracking_Difference_Filled, coalesce(trim(Benchmark_Index), '') != '' as Benchmark_Filled from e left join context c using (Symbol) left join m using (Symbol)""")
def import_output(spark, sf_dir):
    p, k, size = panel.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    context = _context(spark, sf_dir)
    source = p.where(k % 6 != 0).select(k.cast("string").alias("Scheme_Code"), F.col("p_name").alias("Scheme_Name"), F.lit(None).cast("string").alias("ISIN"), F.when(size % 3 != 0, size / 1000).alias("TER"), F.when(size % 2 == 0, size / 500).alias("Tracking_Error"), F.lit(None).cast("double").alias("Tracking_Difference"), F.when(size % 5 == 0, " ").otherwise(F.col("p_type")).alias("Benchmark_Index"))
    by_code = context.select("Symbol", F.col("AMFI_Scheme_Code").alias("Scheme_Code")).join(source.hint("shuffle_hash"), "Scheme_Code")
    matched = by_code.withColumns({"Match_Method": F.lit("code"), "Match_Score": F.lit(1.0), "Source": F.lit("parts")})
    etfs = p.groupBy(F.concat(F.lit("S"), k % 700).alias("Symbol")).agg(F.when(F.min(k) % 3 == 0, F.concat(F.lit("OWN"), F.min(k))).alias("ISIN"), F.min("p_brand").alias("Name"))
    out = imports.import_output(etfs, context, matched)
    rounded = r4(*imports.VALUES)
    return out.select(*(c for c in out.columns if c not in imports.VALUES), *rounded)
