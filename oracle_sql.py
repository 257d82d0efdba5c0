"""DuckDB oracle SQL for every checked query in ``__spark_entry__.queries()``.

Written independently of the Spark code: fixed effects are computed with
centred sums over plot rows (not the sufficient-statistic algebra used on
Spark), first-per-key with window ranks, quantiles with ``quantile_cont``.
The benchmark tables are pre-registered views; the trial views are CTEs.
"""

from __future__ import annotations

V_TRIAL = """trial as (
  select concat('H', l_partkey % 40) as Hybrid, concat('L', l_suppkey % 8) as Field_Location,
         cast(year(l_shipdate) + 23 as int) as Year,
         concat('L', l_suppkey % 8, '_', year(l_shipdate) + 23) as Env,
         case when l_suppkey % 8 = 7 then 1 else l_linenumber % 2 + 1 end as Replicate,
         l_orderkey % 4 as Block,
         case when l_orderkey % 29 = 0 then null when l_orderkey % 53 = 0 then l_quantity + 60
              else l_quantity end as Yield_Mg_ha
  from lineitem)"""

# one hybrid per part instead of 40 hybrids
V_TRIAL_WIDE = V_TRIAL.replace("l_partkey % 40", "l_partkey").replace("trial as", "trial_wide as")

V_TRIAL3 = """trial3 as (
  select concat('H', l_partkey % 40) as Hybrid, concat('L', l_suppkey % 8) as Field_Location,
         cast(year(l_shipdate) + 23 as int) as Year,
         concat('L', l_suppkey % 8, '_', year(l_shipdate) + 23) as Env,
         l_linenumber % 3 + 1 as Replicate, l_orderkey % 4 as Block,
         case when l_orderkey % 29 = 0 then null when l_orderkey % 53 = 0 then l_quantity + 60
              else l_quantity end as Yield_Mg_ha
  from lineitem)"""

V_WEATHER_RAW = """weather_raw as (
  select case when o_custkey % 8 = 1 and year(o_orderdate) in (1996, 1998)
              then concat('L1_', 1 + o_orderkey % 2, '_', year(o_orderdate) + 23)
              else concat('L', o_custkey % 8, '_', year(o_orderdate) + 23) end as Env,
         o_orderkey as ord,
         case when o_custkey % 8 = 3 and o_orderkey % 97 = 0 then null
              else cast(floor(o_totalprice) as double) end as w1,
         cast(o_orderkey % 31 as double) as w2
  from orders)"""

RECODE_CASE = """case Env when 'L1_1_2019' then 'L1_2019' when 'L1_2_2019' then 'L1_2019'
                 when 'L1_1_2021' then 'L1_2021' when 'L1_2_2021' then 'L1_2021' else Env end"""

V_META = """meta as (
  select Env,
         case when (loc + yr) % 5 = 0 or loc = 6 then null else cast(40 + loc + yr % 3 as double) end as lat,
         case when (loc = 5 and yr % 2 = 0) or loc = 6 then null else cast(-90 - loc as double) end as lon,
         case when loc = 6 then null else cast(yr - 2000 as double) end as m3,
         case when loc = 6 then null else cast(2 * loc as double) end as m4,
         case when loc = 6 then null else cast(loc + yr as double) end as m5,
         case when loc = 6 then null else cast(loc * 7 as double) end as m6,
         case when loc = 6 then null else cast(yr % 4 as double) end as m7
  from (select distinct concat('L', l_suppkey % 8, '_', year(l_shipdate) + 23) as Env,
               l_suppkey % 8 as loc, year(l_shipdate) + 23 as yr from lineitem) z)"""

V_GENO_LONG = """geno_long as (
  select concat('H', vec_id) as Hybrid, cast(i as int) as i,
         case when (vec_id + i) % 17 = 0 then null when e < -0.08::double then 0.0::double
              when e > 0.08::double then 1.0::double else 0.5::double end as v
  from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as e
        from embeddings) q)"""

V_TEST_TEMPLATE = """test_template as (
  select distinct concat('L', l_suppkey % 8, '_', year(l_shipdate) + 23) as Env,
         concat('H', l_partkey % 40) as Hybrid, cast(null as double) as Yield_Mg_ha
  from lineitem where year(l_shipdate) = 2001)"""

V_PRED = """pred as (
  select concat('L', l_suppkey % 8, '_', year(l_shipdate) + 23) as Env, concat('H', l_partkey % 40) as Hybrid,
         sum(l_quantity) as y_add, cast(max(l_linenumber) as double) as y_dom, cast(count(*) as double) as y_env
  from lineitem group by 1, 2)"""


def blue_ctes(src: str, prefix: str = "b") -> str:
    """k = 1 BLUE per (Year, Field_Location) site with >= 2 replicate levels.

    Produces CTE ``{prefix}_blue(Year, Field_Location, Hybrid, Yield_Mg_ha, Env)``.
    """
    p = prefix
    return f"""{p}_ph as (select * from {src} where Yield_Mg_ha is not null and Replicate is not null),
{p}_site as (select Year, Field_Location, min(Replicate) as ref, count(distinct Replicate) as nrep
             from {p}_ph group by Year, Field_Location),
{p}_x as (select {p}_ph.*, cast(case when {p}_ph.Replicate = s.ref then 0 else 1 end as double) as d
          from {p}_ph join {p}_site s using (Year, Field_Location) where s.nrep >= 2),
{p}_cm as (select Year, Field_Location, Hybrid, avg(Yield_Mg_ha) as my, avg(d) as md
           from {p}_x group by Year, Field_Location, Hybrid),
{p}_mom as (select x.Year, x.Field_Location, sum((x.d - c.md) * (x.Yield_Mg_ha - c.my)) as sdy,
                   sum((x.d - c.md) * (x.d - c.md)) as sdd, sum(x.d) as nd
            from {p}_x x join {p}_cm c using (Year, Field_Location, Hybrid)
            group by x.Year, x.Field_Location),
{p}_beta as (select Year, Field_Location,
                    case when sdd > 0 and sdd >= 1e-14 * nd then sdy / sdd else 0.0 end as b from {p}_mom),
{p}_blue as (select c.Year, c.Field_Location, c.Hybrid, c.my - bt.b * c.md as Yield_Mg_ha,
                    concat(c.Field_Location, '_', c.Year) as Env
             from {p}_cm c join {p}_beta bt using (Year, Field_Location))"""


def blue_k2_ctes(src: str, prefix: str = "k") -> str:
    """BLUEs with exactly three replicate levels per site (two contrasts), 2 x 2 closed form.

    Contrasts are the second and third smallest levels; the design of the
    fixture is full rank at every site.  Produces ``{prefix}_blue``.
    """
    p = prefix
    return f"""{p}_ph as (select * from {src} where Yield_Mg_ha is not null and Replicate is not null),
{p}_lv as (select Year, Field_Location, Replicate,
                  dense_rank() over (partition by Year, Field_Location order by Replicate) - 1 as pos
           from (select distinct Year, Field_Location, Replicate from {p}_ph) z),
{p}_site as (select Year, Field_Location from {p}_lv group by Year, Field_Location having count(*) = 3),
{p}_x as (select ph.*, cast(lv.pos = 1 as double) as d1, cast(lv.pos = 2 as double) as d2
          from {p}_ph ph join {p}_lv lv using (Year, Field_Location, Replicate)
          where (ph.Year, ph.Field_Location) in (select (Year, Field_Location) from {p}_site)),
{p}_cm as (select Year, Field_Location, Hybrid, avg(Yield_Mg_ha) as my, avg(d1) as m1, avg(d2) as m2
           from {p}_x group by Year, Field_Location, Hybrid),
{p}_mom as (select x.Year, x.Field_Location,
                   sum((x.d1 - c.m1) * (x.d1 - c.m1)) as s11, sum((x.d1 - c.m1) * (x.d2 - c.m2)) as s12,
                   sum((x.d2 - c.m2) * (x.d2 - c.m2)) as s22,
                   sum((x.d1 - c.m1) * (x.Yield_Mg_ha - c.my)) as b1,
                   sum((x.d2 - c.m2) * (x.Yield_Mg_ha - c.my)) as b2
            from {p}_x x join {p}_cm c using (Year, Field_Location, Hybrid)
            group by x.Year, x.Field_Location),
{p}_beta as (select Year, Field_Location,
                    (s22 * b1 - s12 * b2) / (s11 * s22 - s12 * s12) as be1,
                    (s11 * b2 - s12 * b1) / (s11 * s22 - s12 * s12) as be2 from {p}_mom),
{p}_blue as (select c.Year, c.Field_Location, c.Hybrid, c.my - bt.be1 * c.m1 - bt.be2 * c.m2 as Yield_Mg_ha,
                    concat(c.Field_Location, '_', c.Year) as Env
             from {p}_cm c join {p}_beta bt using (Year, Field_Location))"""


def single_rep_ctes(src: str, prefix: str = "s") -> str:
    """Rows of sites with one replicate level: ``{prefix}_single``."""
    p = prefix
    return f"""{p}_site as (select Year, Field_Location from {src}
             where Yield_Mg_ha is not null
             group by Year, Field_Location having count(distinct Replicate) <= 1),
{p}_single as (select t.Year, t.Field_Location, t.Hybrid, t.Yield_Mg_ha, t.Env from {src} t
               where t.Yield_Mg_ha is not null
                 and (t.Year, t.Field_Location) in (select (Year, Field_Location) from {p}_site))"""


def outlier_ctes(src: str, prefix: str = "o") -> str:
    """k = 1 residual outlier flags per Year batch, cell Hybrid_Env: ``{prefix}_flag``."""
    p = prefix
    return f"""{p}_ph as (select *, concat(Hybrid, '|', Env) as Hybrid_Env from {src}
           where Yield_Mg_ha is not null and Replicate is not null),
{p}_lv as (select Year, min(Replicate) as ref from {p}_ph group by Year),
{p}_x as (select {p}_ph.*, cast(case when {p}_ph.Replicate = lv.ref then 0 else 1 end as double) as d
          from {p}_ph join {p}_lv lv using (Year)),
{p}_cm as (select Year, Hybrid_Env, avg(Yield_Mg_ha) as my, avg(d) as md from {p}_x group by Year, Hybrid_Env),
{p}_c as (select x.*, x.Yield_Mg_ha - c.my as yt, x.d - c.md as dt
          from {p}_x x join {p}_cm c using (Year, Hybrid_Env)),
{p}_mom as (select Year, sum(dt * yt) as sdy, sum(dt * dt) as sdd, sum(d) as nd from {p}_c group by Year),
{p}_beta as (select Year, case when sdd > 0 and sdd >= 1e-14 * nd then sdy / sdd else 0.0 end as b
             from {p}_mom),
{p}_r as (select c.*, c.yt - bt.b * c.dt as RESID from {p}_c c join {p}_beta bt using (Year)),
{p}_sd as (select Year, stddev_samp(RESID) as sd from {p}_r group by Year),
{p}_flag as (select r.Hybrid_Env, r.Hybrid, r.Env, r.Year, r.Field_Location, r.Replicate, r.Block,
                    r.Yield_Mg_ha, r.RESID,
                    cast(case when s.sd is not null and abs(r.RESID) > 2 * s.sd then 1 else 0 end as int)
                      as out_flag
             from {p}_r r join {p}_sd s using (Year))"""


def weather_mean_cte(src: str, name: str, strict: bool) -> str:
    if strict:
        agg = ", ".join(f"case when count({c}) = count(*) then avg({c}) end as {c}" for c in ("w1", "w2"))
    else:
        agg = "avg(w1) as w1, avg(w2) as w2"
    return f"{name} as (select Env, {agg} from {src} group by Env)"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def sparse_filter(cols: list[str], max_missing: float = 0.5) -> str:
    """WHERE clause: missing fraction over ``cols`` strictly below ``max_missing``."""
    terms = " + ".join(f"cast({c} is null as int)" for c in cols)
    return f"(({terms}) / {len(cols)}.0) < {max_missing}"


def impute_select(cols_keep: list[str], cols_impute: list[str], group: str = "Field_Location") -> str:
    parts = list(cols_keep) + [f"coalesce({c}, avg({c}) over (partition by {group})) as {c}"
                               for c in cols_impute]
    return ", ".join(parts)


TRIAL_COLS = ["Hybrid", "Field_Location", "Year", "Env", "Replicate", "Block", "Yield_Mg_ha"]
PHENO_COLS = ["Hybrid", "Field_Location", "Year", "Env", "Hybrid_Env", "Yield_Mg_ha"]
TEST_COLS = ["Hybrid", "Field_Location", "Year", "Env", "Hybrid_Field", "Yield_Mg_ha"]
META = ["lat", "lon", "m3", "m4", "m5", "m6", "m7"]
SOIL = ["lon", "m3", "m4", "m5", "m6", "m7"]
TRAIN_YEARS = "(2019, 2020, 2021, 2022, 2023)"

C_WEATHER = f"weather as (select {RECODE_CASE} as Env, ord, w1, w2 from weather_raw)"
C_PLOTS = "plots as (select * from trial where Yield_Mg_ha is not null)"
C_TLOC = "tloc as (select distinct split_part(Env, '_', 1) as Field_Location from test_template)"
C_TK = """tk as (select Hybrid, split_part(Env, '_', 1) as Field_Location,
                 cast(split_part(Env, '_', 2) as int) as Year, Env,
                 concat(Hybrid, '_', split_part(Env, '_', 1)) as Hybrid_Field, Yield_Mg_ha
          from test_template)"""
C_ECF = """ecf as (select Env, ord, w1, w2 from weather
                  qualify row_number() over (partition by Env order by ord) = 1)"""
C_ECF_RAW = """ecfr as (select Env, ord, w1, w2 from weather_raw
                   qualify row_number() over (partition by Env order by ord) = 1)"""
C_MB = """mb as (select Env, lat, lon, m3, m4, m5, m6, m7 from meta
                 where split_part(Env, '_', 1) in (select Field_Location from tloc))"""
C_GENO = [V_GENO_LONG,
          "gd as (select Hybrid, i, v * 2 as v from geno_long)",
          "mu as (select i, round_even(avg(v), 0) as mu from gd group by i)",
          "gi as (select gd.Hybrid, gd.i, coalesce(gd.v, mu.mu) as v from gd join mu using (i))",
          """af as (select i, (2 * count_if(v = 0) + count_if(v = 1)) / (2 * count(v)) as p0,
                           (2 * count_if(v = 2) + count_if(v = 1)) / (2 * count(v)) as p2
                    from gi group by i)""",
          "gz as (select gi.Hybrid, gi.i, coalesce(gi.v - af.p2 * 2, 0.0) as v from gi join af using (i))",
          """gw as (select gi.Hybrid, gi.i,
                           case when coalesce(gi.v, 0) = 0 then af.p2 * af.p2 * -2
                                when coalesce(gi.v, 0) = 1 then af.p2 * (1.0 - af.p2) * 2
                                when coalesce(gi.v, 0) = 2 then (1.0 - af.p2) * (1.0 - af.p2) * -2
                                else 0.0 end as v
                    from gi join af using (i))"""]


def pheno_ctes() -> list[str]:
    """Phenotype table: outliers removed, BLUEs and single-rep rows, filtered."""
    return [V_TRIAL, V_TEST_TEMPLATE, C_TLOC, outlier_ctes("trial"),
            "clean as (select * from o_flag where out_flag = 0)",
            blue_ctes("clean"), single_rep_ctes("clean"),
            f"""pheno as (select Hybrid, Field_Location, Year, Env, concat(Hybrid, '_', Env) as Hybrid_Env,
                             Yield_Mg_ha
                      from (select * from b_blue union all select * from s_single) u
                      where not regexp_matches(Hybrid, 'Replicate')
                        and Field_Location in (select Field_Location from tloc)
                        and Year in {TRAIN_YEARS})"""]


def features_ctes() -> list[str]:
    meta_cols = PHENO_COLS + META
    soil_cols = PHENO_COLS + SOIL
    return pheno_ctes() + [V_WEATHER_RAW, V_META, C_WEATHER, C_MB,
        weather_mean_cte("weather", "wm", True),
        weather_mean_cte("weather", "wms", False),
        "fw as (select p.*, wm.w1, wm.w2 from pheno p left join wm using (Env))",
        C_ECF,
        f"fe as (select * from (select p.*, e.ord, e.w1, e.w2 from pheno p left join ecf e using (Env)) q "
        f"where {sparse_filter(PHENO_COLS + ['ord', 'w1', 'w2'])})",
        f"fm1 as (select * from (select p.*, {', '.join('mb.' + c for c in META)} from pheno p "
        f"left join mb using (Env)) q where {sparse_filter(meta_cols)})",
        f"fm as (select {impute_select(PHENO_COLS, META)} from fm1)",
        "sb as (select Env, lon, m3, m4, m5, m6, m7 from meta)",
        f"fs1 as (select * from (select p.*, {', '.join('sb.' + c for c in SOIL)} from pheno p "
        f"left join sb using (Env)) q where (Year is null or Year not in (2019)) and {sparse_filter(soil_cols)})",
        f"fs as (select {impute_select(PHENO_COLS, SOIL)} from fs1)"]


def test_ctes() -> list[str]:
    return [V_TEST_TEMPLATE, C_TLOC, C_TK, V_WEATHER_RAW, V_META, C_WEATHER, C_MB, C_ECF_RAW,
            weather_mean_cte("weather", "wms", False),
            "tfw as (select t.*, w.w1, w.w2 from tk t left join wms w using (Env))",
            f"tfe as (select * from (select t.*, e.ord, e.w1, e.w2 from tk t left join ecfr e using (Env)) q "
            f"where {sparse_filter(TEST_COLS + ['ord', 'w1', 'w2'])})",
            f"tfm as (select t.*, {', '.join('mb.' + c for c in META)} from tk t left join mb using (Env))",
            "tfs as (select t.*, e.ord, e.w1, e.w2 from tk t left join ecfr e using (Env))"]


def long_sql(src: str, ids: list[str], scalars: list[str], geno: str | None) -> str:
    idl = ", ".join(ids)
    parts = [f"select {idl}, '{c}' as feature, cast({c} as double) as value from {src}" for c in scalars]
    if geno:
        pid = ", ".join(f"t.{c}" for c in ids)
        parts.append(f"select {pid}, concat('g', g.i) as feature, g.v as value "
                     f"from {src} t join {geno} g using (Hybrid)")
    return "\nunion all\n".join(parts)


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    W = [V_WEATHER_RAW, C_WEATHER]

    # sources / projections / scalar functions
    q["scan_trial"] = with_(V_TRIAL) + "select * from trial"
    q["geno_scan"] = with_(V_GENO_LONG) + "select Hybrid, i, v from geno_long"
    q["project_trial"] = with_(V_TRIAL) + "select Hybrid, Env, Year, Yield_Mg_ha from trial"
    q["drop_positions"] = with_(V_META) + "select Env, lon, m3, m4, m5, m6, m7 from meta"
    q["cast_numeric"] = with_(V_WEATHER_RAW) + "select ord, Env, w1 from weather_raw"
    q["select_measures"] = with_(V_WEATHER_RAW) + "select Env, w1, w2 from weather_raw"
    q["recode_env"] = with_(*W) + "select * from weather"
    q["align_columns"] = with_(V_WEATHER_RAW) + "select Env, w1, w2, ord, 0 as w3 from weather_raw"
    q["build_keys"] = with_(V_TRIAL) + """select Hybrid, Env, Field_Location,
        concat(Hybrid, '|', Env) as hybrid_env_bar, concat(Hybrid, '_', Env) as hybrid_env,
        concat(Hybrid, '_', Field_Location) as hybrid_field from trial"""
    q["split_env"] = with_(V_WEATHER_RAW) + """select ord, Env, split_part(Env, '_', 1) as Field_Location,
        split_part(Env, '_', 2) as Year from weather_raw"""
    q["strip_prefix"] = with_(V_TRIAL) + """select Hybrid, concat('Hybrid', Hybrid) as coef_name,
        regexp_replace(concat('Hybrid', Hybrid), 'Hybrid', '', 'g') as stripped from trial"""
    q["round_half_even"] = with_(V_TRIAL) + """select Yield_Mg_ha, Yield_Mg_ha / 2 as half,
        round_even(Yield_Mg_ha / 2, 0) as rounded from trial"""

    # filters
    q["filter_years"] = with_(V_TRIAL) + f"select * from trial where Year in {TRAIN_YEARS}"
    q["filter_not_years"] = with_(V_TRIAL) + "select * from trial where Year is null or Year not in (2017, 2018)"
    jm_cols = TRIAL_COLS + META
    q["drop_sparse_rows"] = with_(V_TRIAL, V_META) + \
        f"select * from (select * from trial left join meta using (Env)) j where {sparse_filter(jm_cols)}"
    q["drop_missing_trait"] = with_(V_TRIAL) + "select * from trial where Yield_Mg_ha is not null"
    q["exclude_pattern"] = with_(V_TRIAL) + "select * from trial where not regexp_matches(Hybrid, 'H1')"
    q["semi_locations"] = with_(V_TRIAL, V_TEST_TEMPLATE, C_TLOC) + \
        "select * from trial where Field_Location in (select Field_Location from tloc)"
    q["semi_test_sites"] = with_(V_TRIAL_WIDE) + """select * from trial_wide where (Field_Location, Hybrid) in
        (select (Field_Location, Hybrid) from trial_wide where Year = 2024)"""
    q["semi_weather"] = with_(V_WEATHER_RAW, V_META) + \
        "select * from weather_raw where Env in (select Env from meta)"

    # joins
    q["join_weather"] = with_(V_TRIAL, C_PLOTS, *W, weather_mean_cte("weather", "wm", True)) + \
        "select p.*, wm.w1, wm.w2 from plots p left join wm using (Env)"
    q["join_meta"] = with_(V_TRIAL, C_PLOTS, V_META) + "select * from plots left join meta using (Env)"
    q["join_feature_blocks"] = with_(*features_ctes()) + \
        "select * from fm join (select distinct Hybrid_Env, w1, w2 from fw) w using (Hybrid_Env)"
    q["join_geno"] = with_(*pheno_ctes(), *C_GENO) + """select p.Hybrid_Env, p.Hybrid, p.Env, p.Yield_Mg_ha,
        g.geno_sum, cast(g.geno_n as int) as geno_n from pheno p left join
        (select Hybrid, sum(coalesce(v, 0)) as geno_sum, count(v) as geno_n from gi group by Hybrid) g
        using (Hybrid)"""

    # aggregates
    q["weather_mean_strict"] = with_(*W, weather_mean_cte("weather", "wm", True)) + "select * from wm"
    q["weather_mean_skipna"] = with_(*W, weather_mean_cte("weather", "wm", False)) + "select * from wm"
    q["replicate_counts"] = with_(V_TRIAL) + """select Year, Field_Location, count(distinct Replicate) as n_rep
        from trial where Yield_Mg_ha is not null and Replicate is not null group by Year, Field_Location"""
    q["first_per_env"] = with_(V_WEATHER_RAW) + \
        "select * from weather_raw qualify row_number() over (partition by Env order by ord) = 1"
    q["distinct_locations"] = with_(V_TRIAL) + "select distinct Field_Location from trial"
    prof = []
    for c in ["Year", "Replicate", "Block", "Yield_Mg_ha"]:
        x = f"cast({c} as double)"
        prof.append(f"""select '{c}' as column, min({x}) as min, quantile_cont({x}, 0.25) as q1,
            quantile_cont({x}, 0.5) as median, avg({x}) as mean, quantile_cont({x}, 0.75) as q3,
            max({x}) as max, count(*) - count({c}) as na_count from trial""")
    q["column_profile"] = with_(V_TRIAL) + "\nunion all\n".join(prof)
    nc = [f"""select '{c}' as column, count(*) - count({c}) as n_null, count({c}) as n_not_null from jm"""
          for c in ["Env"] + [c for c in TRIAL_COLS if c != "Env"] + META]
    q["null_counts"] = with_(V_TRIAL, C_PLOTS, V_META,
                             "jm as (select * from plots left join meta using (Env))") + "\nunion all\n".join(nc)
    q["geno_null_cells"] = with_(*C_GENO) + """select cast(count(*) - count(v) as bigint) as n_null,
        cast(count(v) as bigint) as n_not_null from gi"""
    q["table_shape"] = with_(V_TRIAL, V_WEATHER_RAW, V_META) + """
        select 'trial' as "table", count(*) as n_rows, 7 as n_cols from trial
        union all select 'weather', count(*), 4 from weather_raw
        union all select 'meta', count(*), 8 from meta
        union all select 'geno', count(*), 2 from embeddings"""
    q["impute_group_mean"] = with_(V_TRIAL, C_PLOTS, V_META,
                                   "jm as (select * from plots left join meta using (Env))") + \
        f"select {impute_select(TRIAL_COLS, META)} from jm"
    q["union_batches"] = with_(V_TRIAL, C_PLOTS, blue_ctes("plots"), single_rep_ctes("plots")) + \
        "select * from b_blue union all select * from s_single"

    # trial statistics
    q["phenotype_weather"] = with_(V_TRIAL, V_WEATHER_RAW, blue_ctes("trial"), C_WEATHER,
                                   weather_mean_cte("weather", "wm", True)) + \
        "select b.*, wm.w1, wm.w2 from b_blue b left join wm using (Env)"
    q["blue_replicated"] = with_(V_TRIAL, blue_ctes("trial")) + "select * from b_blue"
    q["blue_replicated_k2"] = with_(V_TRIAL3, blue_k2_ctes("trial3")) + "select * from k_blue"
    q["blue_single_rep"] = with_(V_TRIAL, single_rep_ctes("trial")) + "select * from s_single"
    q["outlier_flag"] = with_(V_TRIAL, outlier_ctes("trial")) + "select * from o_flag"
    q["outlier_filter"] = with_(V_TRIAL, outlier_ctes("trial")) + "select * from o_flag where out_flag = 0"
    q["residual_sd"] = with_(V_TRIAL, outlier_ctes("trial")) + \
        "select Year, stddev_samp(RESID) as resid_sd, count(*) as n from o_r group by Year"
    q["phenotype_table"] = with_(*pheno_ctes()) + "select * from pheno"

    # feature blocks
    fc = with_(*features_ctes())
    q["features_weather"] = fc + "select * from fw"
    q["features_ec"] = fc + "select * from fe"
    q["features_meta"] = fc + "select * from fm"
    q["features_soil"] = fc + "select * from fs"
    tc = with_(*test_ctes())
    q["test_features_weather"] = tc + "select * from tfw"
    q["test_features_ec"] = tc + "select * from tfe"
    q["test_features_meta"] = tc + "select * from tfm"
    q["test_features_soil"] = tc + "select * from tfs"

    # genotype
    gc = with_(*C_GENO)
    q["geno_dosage"] = gc + "select Hybrid, i, v from gd"
    q["marker_means"] = gc + "select i, avg(v) as mean from gd group by i"
    q["geno_impute"] = gc + "select Hybrid, i, v from gi"
    q["allele_freq"] = gc + "select * from af"
    q["marker_variance"] = gc + "select i, p0, p2, p2 * (1.0 - p2) * 2 as two_pq from af"
    q["marker_two_pq_total"] = gc + "select sum(p0 * 2 * p2) as two_pq_sum from af"
    q["geno_additive"] = gc + "select Hybrid, i, v as z from gz"
    q["geno_dominance"] = gc + "select Hybrid, i, v as w from gw"
    q["relationship_product"] = gc + """select gz.Hybrid, sum(gz.v * u.u) / (select sum(p0 * 2 * p2) from af) as y
        from gz join (select gz.i, sum(gz.v * h.x) as u
                      from gz join (select Hybrid, count_if(v = 1)::double as x from gi group by Hybrid) h using (Hybrid)
                      group by gz.i) u using (i) group by gz.Hybrid"""
    q["variance_moments"] = with_(V_TRIAL_WIDE, *C_GENO) + """, hy as (
          select t.Hybrid, avg(Yield_Mg_ha) as y from trial_wide t
          where t.Hybrid in (select Hybrid from gi) group by t.Hybrid having avg(Yield_Mg_ha) is not null),
        x0 as (select Hybrid, b, case when b = 0 then y when md5(concat(Hybrid, ':', b))[1] < '8' then 1.0 else -1.0 end as x
               from hy, range(0, 5) as r(b)),
        x as (select Hybrid, b, x - avg(x) over (partition by b) as x from x0),
        codes as (select 'additive' as c, *, (select sum(p0 * 2 * p2) from af) as d from gz union all
                  select 'dominance', *, (select sum((p2 * 2 * (1 - p2)) ** 2) from af) from gw),
        u as (select c, b, i, sum(v * x) as u from codes join x using (Hybrid) group by c, b, i),
        k as (select c, b, Hybrid, sum(v * u) / any_value(d) as x from codes join u using (c, i)
              where Hybrid in (select Hybrid from hy) group by c, b, Hybrid
              union all select 'residual', b, Hybrid, x from x),
        kc as (select c, b, Hybrid, x - avg(x) over (partition by c, b) as x from k)
        select p.c as i, q.c as j, sum(p.x * q.x) / 4 as value from kc p join kc q using (b, Hybrid)
        where b > 0 and p.c <= q.c group by p.c, q.c
        union all select k.c, null, sum(k.x * x.x) from k join x using (b, Hybrid) where b = 0 group by k.c"""

    # matrices, folds
    tw = "tw as (select * from fm join (select distinct Hybrid_Env, w1, w2 from fw) w using (Hybrid_Env))"
    ids = ["Hybrid_Env", "Hybrid", "Env", "Year", "Yield_Mg_ha"]
    base = with_(*features_ctes(), *C_GENO, tw)
    q["train_matrix"] = base + long_sql("tw", ids, META + ["w1", "w2"], "gi")
    q["train_matrix_additive"] = base + long_sql("tw", ids, META + ["w1", "w2"], "gz")
    q["train_matrix_dominance"] = base + long_sql("tw", ids, META + ["w1", "w2"], "gw")
    q["train_matrix_env"] = with_(*features_ctes(), tw) + long_sql("tw", ids, META + ["w1", "w2"], None)
    tt = "tt as (select * from tfm join (select distinct Hybrid_Field, w1, w2 from tfw) w using (Hybrid_Field))"
    q["test_matrix"] = with_(*test_ctes(), *C_GENO, tt) + \
        long_sql("tt", ["Hybrid_Field", "Hybrid", "Env"], META + ["w1", "w2"], "gi")
    q["predict_given_trees"] = with_(*test_ctes(), tt) + """select Env, Hybrid,
        (25 + case when m6 is null or m6 <= 20 then case when w2 <= 14.7 then 1.5 else -0.5 end else 2.25 end
           + case when lat <= 45.5 then -1.0 when m6 <= 10 then 0.25 else 0.75 end)::double as Yield_Mg_ha from tt"""
    env = with_(*features_ctes(), tw)
    q["folds_leave_year_out"] = env + \
        "select Hybrid_Env, Year, cast(dense_rank() over (order by Year) - 1 as int) as fold from tw"
    q["folds_contiguous"] = env + """select Year, Field_Location, Hybrid, Hybrid_Env,
        cast(ntile(5) over (order by Year, Field_Location, Hybrid) - 1 as int) as fold from tw"""
    q["cv_mse"] = with_(*features_ctes(), tw,
        "tf as (select *, cast(dense_rank() over (order by Year) - 1 as int) as fold from tw)",
        "per as (select fold, count(*) as n, sum(Yield_Mg_ha) as s from tf group by fold)",
        "tot as (select sum(n) as tot_n, sum(s) as tot_s from per)",
        "mm as (select fold, n, (tot_s - s) / (tot_n - n) as m from per, tot)") + \
        """select fold, n, avg((Yield_Mg_ha - m) * (Yield_Mg_ha - m)) as mse
           from tf join mm using (fold) group by fold, n"""

    # keys that grow with the data
    q["outlier_flag_two_year"] = with_(V_TRIAL, "trial_p as (select * exclude (Year), Year - Year % 2 as Pair from trial)",
                                       outlier_ctes("trial_p").replace("Year", "Pair")) + "select * from o_flag"
    q["outlier_flag_wide"] = with_(V_TRIAL_WIDE, outlier_ctes("trial_wide")) + "select * from o_flag"
    q["blue_replicated_wide"] = with_(V_TRIAL_WIDE, blue_ctes("trial_wide")) + "select * from b_blue"
    q["join_geno_wide"] = with_(V_TRIAL_WIDE, *C_GENO) + """select Hybrid, Env, Replicate, Block, Yield_Mg_ha,
        g.geno_sum, cast(g.geno_n as int) as geno_n from trial_wide left join
        (select Hybrid, sum(coalesce(v, 0)) as geno_sum, count(v) as geno_n from gi group by Hybrid) g using (Hybrid)"""
    q["vcf_scan"] = '''select cast(label as varchar) as "CHROM", cast(vec_id as varchar) as "POS",
        concat('v', vec_id) as "ID" from embeddings'''
    q["prediction_csv"] = with_(V_PRED) + "select Env, Hybrid, y_add as Yield_Mg_ha from pred"

    # ensembles
    q["ensemble_weighted2"] = with_(V_PRED) + """select Env, Hybrid,
        y_add * (4.0::double / 5.0::double) + y_dom * (1.0::double / 5.0::double) as Yield_Mg_ha from pred"""
    q["ensemble_weighted3"] = with_(V_PRED) + """select Env, Hybrid,
        y_add * (4.0::double / 8.0::double) + y_dom * (1.0::double / 8.0::double)
        + y_env * (3.0::double / 8.0::double) as Yield_Mg_ha from pred"""
    q["ensemble_equal"] = with_(V_PRED) + "select Env, Hybrid, (y_add + y_dom) / 2 as Yield_Mg_ha from pred"
    return q
