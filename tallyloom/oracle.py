"""DuckDB twins of the registered queries, by name."""

PART_CASE = "case when regexp_matches(p_name,'ring') then 'ring' when regexp_matches(p_name,'bolt|nut|screw') then 'fastener' when regexp_matches(p_name,'^red') then 'red' when regexp_matches(p_name,'^small|^tiny') then 'small' else 'other' end"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
RANKS = "rank() over ({p} order by {c}) + (count(*) over (partition by {k}{c}) - 1) / 2.0"


def _rank(column: str, by: str = "") -> str:
    return RANKS.format(p=f"partition by {by}" if by else "", c=column, k=f"{by}, " if by else "")


def _bins(group: str, test: str) -> str:
    return f"""with b as (select {group}, {test} as bin from lineitem), c as (select {group}, bin, count(*) n from b where bin is not null group by all)
        select {group}, bin, n, round(n / sum(n) over (partition by {group}), 6) as share from c"""


_WITHIN = f"""with fit as (select l_suppkey from lineitem group by 1 having count(*) >= 5 and count(distinct l_quantity) >= 3 and count(distinct {{y}}) >= 3),
    r as (select l_suppkey, {_rank('l_quantity', 'l_suppkey')} as rx, {{ry}} as ry from lineitem where l_suppkey in (select l_suppkey from fit))
    select l_suppkey, count(*) as n, corr(rx, ry) as rho from r group by 1"""
_FLAGS = "concat_ws('; ', case when l_discount >= 0.1 then 'top discount' end, case when l_quantity < 3 then 'small quantity' end, case when l_tax = 0 then 'no tax' end, case when l_extendedprice / l_quantity < 500 then 'cheap' end)"
_FIXED = """select event_id, case when event_id % 6 = 0 then 'fixed' else event_type end as event_type,
    case when event_id % 3 = 0 then try_cast(json_extract_string(props, '$.k') as double) else value end as value from events"""


def _beta(x: str, a: str, b: str, steps: int = 2000) -> str:
    """The regularised incomplete beta function by Simpson's rule over the angle whose squared sine is x."""
    at = f"(i * asin(sqrt({x})) / {steps})"
    log = f"(2 * ({a}) - 1) * ln(greatest(sin({at}), 1e-300)) + (2 * ({b}) - 1) * ln(greatest(cos({at}), 1e-300)) - (lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"
    return f"(2 * list_sum(list_transform(range(0, {steps + 1}), lambda i: (case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * exp({log}))) * asin(sqrt({x})) / {3 * steps})"


def _normal(z: str, steps: int = 2000) -> str:
    """Both tails of the normal law by Simpson's rule."""
    at = f"(i * abs({z}) / {steps})"
    return f"(1 - sqrt(2 / pi()) * list_sum(list_transform(range(0, {steps + 1}), lambda i: (case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * exp(-{at} * {at} / 2))) * abs({z}) / {3 * steps})"


def _quantiles(ask: str, steps: int = 400) -> str:
    """CTEs after one named ``ask`` (id, p, a, b): ``got`` (id, x) with beta_cdf(x) = p, by halving."""
    return f"""ask as materialized ({ask}), halves as (select id, p, a, b, 0.0::double as low, 1.0::double as high, 0 as i from ask
        union all select id, p, a, b, case when below < p then (low + high) / 2 else low end, case when below < p then high else (low + high) / 2 end, i + 1 from (select *, {_beta("(low + high) / 2", "a", "b", steps)} as below from halves where i < 40)),
        got as (select id, (low + high) / 2 as x from halves where i = 40)"""


_T = "case when pooled > 0 then difference / sqrt(pooled * (1.0::double / na + 1.0::double / nb)) when difference <> 0 then sign(difference) * 'infinity'::double end"


def _arm_pairs(table: str, arm: str, value: str, by: str) -> str:
    keep = f"{by} as k" if by else "0 as k"
    return f"""arms as (select {keep}, {arm} as arm, count(*)::double as n, avg({value}) as m, var_samp({value}) as v from {table} group by all having count(*) > 1),
        pairs as (select a.k, a.arm as a, b.arm as b, a.m - b.m as difference, a.n + b.n - 2 as dof, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) as pooled, a.n as na, b.n as nb, count(*) over (partition by a.k) as tests from arms a join arms b on a.k = b.k and a.arm < b.arm),
        tested as (select *, {_T} as t from pairs)"""


def _anova(table: str, arm: str, value: str, by: str) -> str:
    keep = f"{by} as k" if by else "0 as k"
    return f"""per as (select {keep}, {arm} as arm, count(*)::double as n, avg({value}) as m, coalesce(var_samp({value}), 0) as v from {table} group by all),
        mid as (select *, sum(n * m) over (partition by k) / sum(n) over (partition by k) as mean from per),
        f as (select k, count(*) as arms, sum(n)::bigint as n, (sum(n * pow(m - mean, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) as f from mid group by k)"""


def _signed(table: str, value: str, by: str) -> str:
    keep = f"{by} as k" if by else "0 as k"
    return f"""known as (select {keep}, abs({value}) as size, ({value}) > 0 as up from {table} where {value} is not null and ({value}) <> 0),
        ranked as (select *, {_rank('size', 'k')} as r, count(*) over (partition by k, size)::double as ties from known),
        w as (select k, count(*) as n, sum(case when up then r else 0 end)::double as w, sum(ties * ties - 1) as tie from ranked group by k),
        z as (select *, (w - n * (n + 1) / 4.0::double) / sqrt(n * (n + 1.0::double) * (2 * n + 1) / 24 - tie / 48) as z from w)"""


_GRADED = """g as (select doc_id % 3 as bucket, quality = 0 as w, toxic = 1 as metric, doc_id % 7 = 0 as judge, toxic <> 1 and doc_id % 7 <> 0 as s, case when toxic <> 1 and doc_id % 7 <> 0 then 4.0::double else 1.0::double end as m from labels),
    r as (select bucket, w, s, m, 'metric' as grader, metric as f from g union all select bucket, w, s, m, 'judge', judge from g),
    c as materialized (select bucket, grader, count(*) as n, sum(m) as everything, count_if(f) as flagged, count_if(f and w) as hits, count_if(f = w) as same, coalesce(sum(m) filter (f = w), 0) as same_w, coalesce(sum(m) filter (f and w), 0) as a, coalesce(sum(m) filter (f and not w), 0) as b,
        coalesce(sum(m) filter (not f and w), 0) as c, coalesce(sum(m) filter (not f and not w), 0) as d, round(coalesce(sum(m) filter (s), 0)) as pool, count_if(s) as drawn, count_if(s and w) as drawn_wrong, coalesce(sum(m) filter (not s and w), 0) as census_wrong, coalesce(sum(m) filter (not s and w and f), 0) as caught from r group by all)"""
_GRADED_ASK = "select 'pl' || bucket || grader as id, 0.025 as p, hits + 0.5 as a, flagged - hits + 0.5 as b from c union all select 'ph' || bucket || grader, 0.975, hits + 0.5, flagged - hits + 0.5 from c union all select 'rl' || bucket || grader, 0.025, drawn_wrong + 0.5, drawn - drawn_wrong + 0.5 from c union all select 'rh' || bucket || grader, 0.975, drawn_wrong + 0.5, drawn - drawn_wrong + 0.5 from c"
_BINOMIAL = "case when 2 * least({k}, {n} - {k}) >= {n} then 1 else least(1, 2 * list_sum(list_transform(range(0, (least({k}, {n} - {k}) + 1)::bigint), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))) end"


def _edges(log: bool, bins: int) -> str:
    if log:
        return f"list_concat([a], list_transform(range(1, {bins - 1}), lambda i: pow(10, log10(a) + i * ((log10(b) - log10(a)) / {bins - 1}))), [b])"
    return f"list_concat([a], list_transform(range(1, {bins - 1}), lambda i: a + i * ((b - a) / {bins - 1})), [b])"


def _histogram(table: str, value: str, bins: int, clip: float, log: bool, split: str = "") -> str:
    keep = f"{split}, " if split else ""
    return f"""with v as (select {keep}{value}::double as v from {table} where {value} is not null), c as (select * from v where v <= (select quantile_cont(v, {clip}) from v) {'and v > 0' if log else ''}), e as (select min(v) as a, max(v) as b from c), g as (select {_edges(log, bins)} as e from e),
        p as (select {keep}least(len(list_filter(e, lambda x: x <= v)), {bins - 1}) as place, e from c, g) select {keep}place - 1 as bin, round(e[place], 4) as low, round(e[place + 1], 4) as high, count(*) as n from p group by all"""


#: The key and the extraction of ``queries.extraction``.
_EXTRACTION = """keys as materialized (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 as index, p_name, l_quantity, l_extendedprice, l_discount, l_partkey, l_suppkey from lineitem join part on l_partkey = p_partkey),
    found as materialized (select l_orderkey, index * 7 % 1000 as index, case when l_partkey % 5 = 0 then p_name || 's' when l_partkey % 13 = 0 then 'unknown' else p_name end as p_name, case when l_suppkey % 3 = 0 then l_quantity * 1.5::double else l_quantity end as l_quantity,
        l_extendedprice * 1.001::double as l_extendedprice, case when l_partkey % 4 <> 0 then l_discount end as l_discount from keys where l_suppkey % 11 <> 0)"""


def _penalty(c: str) -> str:
    return f"case when a.{c} is null and b.{c} is null then 0 when a.{c} is null or b.{c} is null then 1 when abs(a.{c} - b.{c}) <= 0.01 then 0 else least(abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c})) / 0.2::double, 1) end::double"


#: All matchings of the pairs of each order, row by row, of which the cheapest counts; a row alone costs 10.
_MATCHINGS = f"""pairs as materialized (select a.l_orderkey as k, a.index as i, b.index // 7 as j, ({_penalty('l_quantity')} + {_penalty('l_extendedprice')} + {_penalty('l_discount')}) / 4 as c from keys a join found b on a.l_orderkey = b.l_orderkey and a.p_name = b.p_name),
    rows as materialized (select k, i, row_number() over (partition by k order by i) as r, count(*) over (partition by k) as n from (select distinct k, i from pairs)),
    made as (select distinct k, 0::bigint as r, 0::bigint as used, 0::bigint as m, 0::double as cost, n from rows
        union all select s.k, s.r + 1, case when o.j is null then s.used else s.used | (1::bigint << o.j) end, s.m + (o.j is not null)::int, s.cost + coalesce(o.c, 10), s.n from made s join rows t on t.k = s.k and t.r = s.r + 1
            join (select k, i, j, c from pairs union all select distinct k, i, null, null from pairs) o on o.k = s.k and o.i = t.i and (o.j is null or (s.used >> o.j) & 1 = 0))"""

#: Parts as the records of ``queries._named``.
_SOLVENTS = "['EG', 'ethylene glycol', 'MEG', 'H2O', 'water', 'ethanol', '1-butanol', 'water / ethylene glycol', 'DEG', 'CH3OH', 'MeOH']"
_NAMED = f"""r as materialized (select p_partkey, case p_partkey % 11 when 0 then p_name || ' hydrate' when 1 then p_name || ' / ' || p_type when 2 then '5 wt% ' || p_name when 3 then 'ZnO ' || p_name when 4 then 'KOH' when 5 then 'Sodium hydroxide ' || p_type when 6 then 'none' when 7 then null else p_name end as name,
    case when p_partkey % 5 <> 0 then upper(p_name[1:6]) || case when p_partkey % 2 = 0 then '.O' else '' end end as structure, case p_partkey % 3 when 0 then 'LLM written' when 1 then 'confirmed' end as source,
    case when p_size % 13 < 11 then {_SOLVENTS}[p_size % 13 + 1] when p_size % 13 = 11 then lower(p_type) end as solvent, p_size::double as part, case when p_partkey % 6 <> 0 then p_retailprice else 0 end as whole from part)"""
_FAMILIES = ("^(water|h2o|distilled water|deionis?zed water|di water)$", "^(eg|ethylene glycol|ethyleneglycol|mono ?ethylene glycol|meg)$", "^(methanol|meoh|ch3oh)$")

SQL = {
    "route_cascade_counts": f"select {PART_CASE} as label, count(*) as n, 'part' as of from part group by 1 union all select case when source = 'src0' then 'main' when regexp_matches(source, '^src1[0-9]$') then 'teens' else 'other' end, count(*), 'document' from documents group by 1",
    "canonical_alias_counts": "select case lower(c_mktsegment) when 'automobile' then 'vehicle' when 'machinery' then 'industry' when 'building' then 'industry' else lower(c_mktsegment) end as name, count(*) as n, count(distinct c_mktsegment) as spellings, count(distinct c_nationkey) as nations from customer group by 1",
    "rules_fired_ambiguous": "select regexp_matches(p_name,'ring')::int + regexp_matches(p_name,'bolt|nut|screw')::int + regexp_matches(p_name,'^red')::int + regexp_matches(p_name,'^small|^tiny')::int as fired, count(*) as n, count(distinct p_name) as names from part group by 1",
    "quality_flags_lineitem": f"select {_FLAGS} as flags, count(*) as n from lineitem group by 1",
    "quality_report_lineitem": """with c as (select count(*) total, count_if(l_discount >= 0.1) a, count_if(l_quantity < 3) b, count_if(l_tax = 0) c, count_if(l_extendedprice / l_quantity < 500) d from lineitem)
        select rule, n, total, round(n / total, 6) as share from (select 'top discount' as rule, a as n, total from c union all select 'small quantity', b, total from c union all select 'no tax', c, total from c union all select 'cheap', d, total from c)""",
    "duplicate_of_first": "select doc_id, f as duplicate_of from (select doc_id, min(doc_id) over (partition by text) as f from documents) where f < doc_id",
    "duplicate_rows": "select sum(n - 1)::bigint as extra, coalesce(sum(case when n > 1 then n end), 0)::bigint as involved from (select count(*) n from events group by user_id, event_type, ts::date)",
    "fill_rate_by_group": """with w as (select event_type, avg((nullif(user_id % 7, 0) is not null)::int) as user, avg((value > 5)::int) as amount, avg((json_extract_string(props, '$.k') is not null)::int) as k from events group by 1)
        select event_type, field, round(filled, 6) as filled from w unpivot (filled for field in (user, amount, k))""",
    "within_group_spearman": f"select l_suppkey, n, round(rho, 6) as rho from ({_WITHIN.format(y='l_extendedprice', ry=_rank('l_extendedprice', 'l_suppkey'))})",
    "pooled_vs_within": f"""with p as (select count(*) as pooled_n, round(corr(rx, ry), 6) as pooled from (select {_rank('l_quantity')} as rx, {_rank('l_discount')} as ry from lineitem)),
        w as ({_WITHIN.format(y='l_discount', ry=_rank('l_discount', 'l_suppkey'))})
        select pooled_n, pooled, (select count(*) from w) as groups, (select round(median(rho), 6) from w) as median_rho, (select round(avg((sign(rho) = 1)::int), 6) from w) as as_expected from p""",
    "numeric_penalty_bands": """with s as (select l_orderkey, sum(l_extendedprice::decimal(18,2))::double as lines from lineitem group by 1),
        p as (select case when o_totalprice is null and lines is null then 0.0 when o_totalprice is null or lines is null then 1.0 when abs(o_totalprice - lines) <= 0.01 then 0.0
            else least(abs(o_totalprice - lines) / greatest(abs(o_totalprice), abs(lines)) / 0.2, 1.0) end::double as p from orders left join s on l_orderkey = o_orderkey)
        select floor(round(p * 10, 6))::bigint as band, count(*) as n, round(avg(p), 6) as mean_penalty from p group by 1""",
    "tolerance_band_join": """with p as (select p_partkey, p_brand, p_type, nullif(p_size, 7)::double as s, p_retailprice as r from part)
        select a.p_brand, a.p_type, a.p_partkey as p_partkey_l, b.p_partkey as p_partkey_r from p a join p b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey
        where coalesce(abs(a.s - b.s) <= 0.05 * greatest(abs(a.s), abs(b.s), 1e-9), true) and abs(a.r - b.r) <= 0.05 * greatest(abs(a.r), abs(b.r), 1e-9)""",
    "semi_anti_resume": "select lang, count(*) as n, case when doc_id in (select doc_id from labels) then 'done' else 'pending' end as state from documents group by 1, 3",
    "key_overlap": "select (select count(*) from documents where doc_id not in (select doc_id from labels)) as only_documents, (select count(distinct doc_id) from labels where doc_id not in (select doc_id from documents)) as only_labels, (select count(*) from documents where doc_id in (select doc_id from labels)) as both",
    "agreement_kappa": """with c as (select count_if(quality = 1 and toxic = 0) yy, count_if(quality = 1 and toxic <> 0) yn, count_if(quality <> 1 and toxic = 0) ny, count_if(quality <> 1 and toxic <> 0) nn from labels),
        a as (select *, (yy + nn) / (yy + yn + ny + nn) as po, ((yy + yn) * (yy + ny) + (nn + yn) * (nn + ny)) / (yy + yn + ny + nn)::double / (yy + yn + ny + nn) as pe from c)
        select yy, yn, ny, nn, round(po, 6) as agree, round((po - pe) / (1 - pe), 6) as kappa from a""",
    "weighted_prf": """with s as (select sum(case when quality = 1 and toxic = 0 then w else 0 end)::double tp, sum(case when quality = 1 and toxic <> 0 then w else 0 end)::double fp, sum(case when quality <> 1 and toxic = 0 then w else 0 end)::double fn from (select *, doc_id % 5 + 1 as w from labels))
        select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from s""",
    "verdict_partition": "select user_id % 10 as bucket, count_if(event_type in ('purchase', 'signup')) as accepted, count_if(event_type = 'error') as rejected, count_if(event_type in ('view', 'click')) as open, count(*) as n, count_if(event_type in ('purchase', 'signup', 'error', 'view', 'click')) = count(*) as whole from events group by 1",
    "explode_counter": "select length(w)::int as length, count(*) as n from (select unnest(string_split_regex(regexp_replace(text, '[^ a-zA-Z]', ' ', 'g'), ' +')) as w from documents) where w <> '' group by 1",
    "pareto_frontier": "select distinct p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size <= a.p_size and b.p_retailprice >= a.p_retailprice and (b.p_size < a.p_size or b.p_retailprice > a.p_retailprice))",
    "threshold_sweep": """with o as (select o_orderkey % 3 <> 0 as gate, case when abs(o_totalprice - 250000) <= 0.01 then 0.0::double else least(abs(o_totalprice - 250000.0::double) / greatest(abs(o_totalprice), 250000.0::double), 1.0::double) end as penalty from orders),
        t as (select unnest([0.1, 0.2, 0.3, 0.5, 1.0])::double as threshold)
        select threshold, count(*) as accepted, round(avg(penalty), 6) as mean_penalty from o join t on gate and penalty < threshold group by 1""",
    "largest_remainder": """with c as (select p_brand, count(*) n from part group by 1), e as (select *, n * 1000 / sum(n) over () as x from c), f as (select *, floor(x) as fl, round(x - floor(x), 9) as rest from e),
        g as (select *, row_number() over (order by rest desc, n desc, p_brand) as place, 1000 - sum(fl) over () as short from f)
        select p_brand as label, n, (fl + (place <= short)::int) / 10 as percent from g""",
    "top_k_other": """with c as (select p_brand, count(*) n from part group by 1), r as (select *, row_number() over (order by n desc, p_brand) as place from c)
        select place::int as place, p_brand as label, n from r where place <= 8 union all select 9, 'other (' || count(*) || ' more)', sum(n)::bigint from r where place > 8 having count(*) > 0""",
    "binned_share_within_group": _bins("l_returnflag", "case when l_quantity > 0 and l_quantity <= 10 then 1 when l_quantity > 10 and l_quantity <= 25 then 2 when l_quantity > 25 and l_quantity <= 40 then 3 when l_quantity > 40 and l_quantity <= 60 then 4 end"),
    "left_closed_bins": _bins("l_linestatus", "case when l_quantity >= 0 and l_quantity < 10 then 1 when l_quantity >= 10 and l_quantity < 25 then 2 when l_quantity >= 25 and l_quantity < 40 then 3 when l_quantity >= 40 and l_quantity < 60 then 4 end"),
    "crosstab_pivot": "select o_orderpriority, count_if(o_orderstatus = 'F') as F, count_if(o_orderstatus = 'O') as O, count_if(o_orderstatus = 'P') as P from orders group by 1",
    "hash_stratified_sample": """with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('17|' || o_orderkey), o_orderkey) as place, count(*) over (partition by o_orderpriority) as n from orders)
        select o_orderpriority, o_orderkey, round(n / least(n, 25), 6) as weight from r where place <= 25""",
    "fingerprint_sample_id": """with f as (select o_custkey, left(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 12) as fp from orders)
        select o_custkey, left(sha256(string_agg(fp, ',' order by fp)), 12) as sample, count(*) as n from f group by 1""",
    "chunk_sentences": f"with s as (select doc_id, unnest({SENTENCES}) as sentence from documents) select doc_id, count(*) as n, max(length(sentence)) as longest, sum(length(sentence))::bigint as chars from s group by 1",
    "chunk_ids": """with h as (select item_id, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::blob || encode(item_id || '|' || left(text, 200))) as h from benchmark)
        select item_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::int % 4) + 1, 1) || h[18:20] || '-' || h[21:32] as chunk_id from h""",
    "citation_resolution": f"""with s as (select doc_id, unnest({SENTENCES}) as chunk from documents), own as (select distinct doc_id // 2 as doc, chunk from s where doc_id % 2 = 0),
        cited as (select doc_id // 2 as doc, chunk from s where doc_id % 2 = 1), e as (select distinct unnest({SENTENCES}) as chunk from benchmark),
        f as (select c.doc, case when o.chunk is not null then 'own' when e.chunk is not null then 'example' else 'unknown' end as found from cited c left join own o on c.doc = o.doc and c.chunk = o.chunk left join e on c.chunk = e.chunk where c.doc in (select doc from own))
        select found, count(*) as n, count(distinct doc) as docs from f group by 1""",
    "apply_fixes_overlay": _FIXED,
    "fixes_changelog": f"with f as ({_FIXED}) select 'value' as field, count(*) as n from f join events e using (event_id) where f.value is distinct from e.value having count(*) > 0 union all select 'event_type', count(*) from f join events e using (event_id) where f.event_type is distinct from e.event_type having count(*) > 0",
    "first_active_answer": """with c as (select conv_id, role as who, case when length(text) > 200 then 'long' else 'short' end as answer, turn < 2 as active from conversations), b as (select *, max(active) over (partition by conv_id) as best from c)
        select conv_id, case when count(distinct answer) = 1 then min(answer) end as answer, count(distinct answer) > 1 as conflict, string_agg(distinct who, ',' order by who) as deciders from b where active = best group by 1""",
    "modal_label_group": """with c as (select p_type, p_brand, count(*) n from part group by all), r as (select *, row_number() over (partition by p_type order by n desc, p_brand) as place, sum(n) over (partition by p_type) as total from c)
        select p_type, p_brand as label, n as label_n, total::bigint as n from r where place = 1""",
    "topk_concentration": """with c as (select o_custkey, count(*) n from orders group by 1), r as (select n, row_number() over (order by n desc, o_custkey) as place from c), t as (select sum(n) as total from c), k as (select unnest([1, 10, 100]) as k)
        select k, sum(n)::bigint as held, any_value(total)::bigint as total, round(sum(n) / any_value(total), 6) as share from k join r on place <= k cross join t group by 1""",
    "rolling_median": "select event_id, round(case when count(value) over w >= 4 then quantile_cont(value, 0.5) over w end, 6) as rolling_median from events window w as (partition by event_type order by ts, event_id rows between 4 preceding and 4 following)",
    "funnel": """with i as (select l_orderkey, count(*) as lines from lineitem group by 1), p as (select o_custkey, count(*) orders, max(coalesce(lines, 0)) as lines, max((o_orderstatus = 'F')::int) as closed from orders left join i on l_orderkey = o_orderkey group by 1),
        c as (select * from customer left join p on o_custkey = c_custkey)
        select 0 as place, 'customer' as step, count(*) as n from c union all select 1, 'ordered', count_if(orders > 0) from c union all select 2, 'many orders', count_if(orders >= 8) from c
        union all select 3, 'closed', count_if(orders >= 8 and closed = 1) from c union all select 4, 'long order', count_if(orders >= 8 and closed = 1 and lines >= 8) from c""",
    "pairwise_votes": "select votes, count(*) as n from (select user_id, count(distinct event_type) as votes from events where event_type <> 'view' group by 1) group by 1",
    "reconciled_counts": "select o_orderpriority, count_if(o_orderstatus = 'F') as before, count_if(o_orderstatus <> 'F') as after, count_if(o_orderstatus <> 'F') - count_if(o_orderstatus = 'F') as change from orders group by 1",
    "noise_between_groups": """with c as (select avg(case when l_returnflag = 'R' then (l_discount > 0.05)::int end) as p1, avg(case when l_returnflag <> 'R' then (l_discount > 0.05)::int end) as p2, count_if(l_returnflag = 'R') as n1, count_if(l_returnflag <> 'R') as n2 from lineitem),
        s as (select *, p1 - p2 as difference, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) as se from c)
        select round(p1, 6) as p1, round(p2, 6) as p2, round(difference, 6) as difference, round(se, 6) as se, n1, n2, abs(difference) <= 2 * se as noise from s""",
    "release_digest": """with a as (select *, p_size > 45 as ex from part), f as (select *, min(p_partkey) over (partition by p_name, p_brand, p_type, ex) as first from a)
        select p_partkey, case when ex then 'unsized' end as excluded_because, case when not ex and first < p_partkey then first end as duplicate_of,
            case when not ex then concat_ws('; ', case when p_size > 40 then 'large' end, case when p_retailprice > 1000 then 'dear' end) end as quality_flags from f""",
    "verified_decisions": "select (o_orderkey % 4 <> 0 or o_orderstatus = 'F') as accepted, o_custkey % 2 as answer, count(*) as n from orders group by 1, 2",
    "grown_policies": """with c as (select 'none' as policy, * from customer where c_acctbal > 5000 union all select 'some', * from customer where c_acctbal > 0 union all select 'all', * from customer)
        select policy, count(*) as n, count(distinct c_mktsegment) as segments from c group by 1""",
    "parity_by_field": """with p as (select 'q' as field, l_quantity as a, l_quantity + l_suppkey % 5 as b from lineitem union all select 'r', l_discount, nullif(l_tax, 0.0) from lineitem)
        select field, count(*) as n, count_if(a = b) as same, count_if(abs(a - b) <= 2) as close, round(count_if(abs(a - b) <= 2) / count(*), 6) as close_share from p where a is not null and b is not null group by 1""",
    "constraint_recall": """with r as (select *, case when o_orderkey % 3 <> 0 and o_orderpriority = '1-URGENT' then 'incorrect' else 'correct' end as v from orders),
        c as (select 'dear' as "constraint", count_if(o_totalprice > 400000) as n, count_if(o_totalprice > 400000 and v <> 'correct') as caught from r union all select 'odd', count_if(o_orderkey % 2 = 1), count_if(o_orderkey % 2 = 1 and v <> 'correct') from r)
        select "constraint", n, caught, round(caught / n, 6) as recall from c""",
    "run_states": "select case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'evaluated' when c_custkey in (select o_custkey from orders where o_orderstatus = 'F') then 'extracted' else 'planned' end as state, count(*) as n from customer group by 1",
    "rescued_rows": "select distinct p_name, p_brand from part a where p_partkey % 2 = 1 and not exists (select 1 from part b where b.p_partkey % 2 = 0 and b.p_name = a.p_name and b.p_brand = a.p_brand)",
    "bootstrap_shift": """with kinds as (select (toxic = 0)::int::double - (quality = 1)::int::double as d, count(*)::double as m from labels where doc_id % 4 = 0 group by 1),
        h as (select d, m, r, md5('3|' || printf('%.6f', d) || '|' || r) as h from kinds, range(10000) t(r)), u as (select d, m, r, ('0x' || substr(h, 1, 12))::bigint / 281474976710656.0::double as u, ('0x' || substr(h, 13, 12))::bigint / 281474976710656.0::double as v from h),
        z as (select *, sqrt(-2 * ln(greatest(u, 1e-300))) * cos(2 * pi() * v) as z from u),
        w as (select d, r, case when m <= 64 then list_sum(list_transform(range(0, (m + 12 * sqrt(m) + 20)::int), lambda i: (list_sum(list_transform(range(0, i + 1), lambda j: exp(j * ln(m) - m - lgamma(j + 1)))) <= u)::int))
            else greatest(0, floor(m + sqrt(m) * z + (z * z - 1) / 6 + 0.5)) end as w from z),
        x as (select sum(d * w) / sum(w) as x from w group by r)
        select (select sum(m)::bigint from kinds) as n, round((select sum(d * m) / sum(m) from kinds) + 1e-9, 6) as shift, round(quantile_cont(x, 0.025) + 1e-9, 6) as low, round(quantile_cont(x, 0.975) + 1e-9, 6) as high from x""",
    "thin_records": """with h as (select p_brand, (p_name is not null)::int + (p_size % 4 <> 0)::int + (p_retailprice > 950)::int + (p_partkey % 3 <> 1)::int + (p_partkey % 5 <> 2)::int as held from part),
        s as (select p_brand, count(*) as records from h group by 1), b(band, place, least_, most) as (values ('5', 0, 5, 5), ('4', 1, 4, 4), ('3', 2, 3, 3), ('2 or fewer', 3, 0, 2))
        select p_brand, band, place, count(held) as n, records, round(count(held) / records, 6) as share from s cross join b left join h on h.p_brand = s.p_brand and held between least_ and most group by s.p_brand, band, place, records""".replace("select p_brand, band", "select s.p_brand, band"),
    "clipped_histogram": _histogram("lineitem", "l_extendedprice", 20, 0.9, False, "l_returnflag"),
    "log_histogram": _histogram("events", "value", 15, 0.99, True),
    "grouped_percentiles": "select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0), 4) as p0, round(quantile_cont(l_extendedprice, 0.25), 4) as p1, round(quantile_cont(l_extendedprice, 0.5), 4) as p2, round(quantile_cont(l_extendedprice, 0.9), 4) as p3, round(quantile_cont(l_extendedprice, 1), 4) as p4 from lineitem group by 1",
    "running_totals": """with o as (select *, round(o_totalprice * 100)::bigint as cents from orders)
        select o_orderkey, (sum(cents) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding))::bigint as before, (sum(cents) over (order by o_orderkey rows between unbounded preceding and 1 preceding))::bigint as before_all from o""",
    "frontier_arms": """with a as (select l_suppkey, avg(l_quantity) as g, stddev_samp(l_quantity) as spread, avg(l_extendedprice) as c, count(*) as repeats from lineitem group by 1 having count(*) >= 3)
        select l_suppkey, round(g, 6) as l_quantity, round(spread, 6) as spread, round(c, 6) as l_extendedprice, repeats, not exists (select 1 from a b where b.c <= a.c and b.g >= a.g and (b.c < a.c or b.g > a.g)) as on_frontier from a""",
    "arm_tests": f"""with {_arm_pairs('lineitem', 'l_returnflag', 'l_quantity', 'l_suppkey')}, p as (select *, {_beta('dof / (dof + t * t)', 'dof / 2', '0.5')} as p from tested)
        select k as l_suppkey, a, b, dof::bigint as dof, round(difference, 6) as difference, round(t, 6) as t, round(p, 6) as p, round(least(1, p * tests), 6) as p_corrected from p""",
    "arm_anova": f"with {_anova('lineitem', 'l_returnflag', 'l_extendedprice', 'l_suppkey')} select k as l_suppkey, arms, n, round(f, 6) as f, round({_beta('(n - arms) / ((n - arms) + (arms - 1) * f)', '(n - arms) / 2.0', '(arms - 1) / 2.0')}, 6) as p from f",
    "grouped_signed_rank": f"with {_signed('lineitem', 'l_quantity - 26', 'l_suppkey')} select k as l_suppkey, n, round(w, 6) as w, case when n > 8 then round({_normal('z')}, 6) end as p from z",
    "proportion_intervals": f"""with recursive c as (select event_type, user_id % 10 as bucket, count(*) as n, count_if(value > 60) as hits from events where value is not null group by all),
        {_quantiles("select 'l' || event_type || bucket as id, 0.025 as p, hits + 0.5 as a, n - hits + 0.5 as b from c union all select 'h' || event_type || bucket, 0.975, hits + 0.5, n - hits + 0.5 from c")}
        select event_type, bucket, n, hits, round(hits / n, 6) as share, round(l.x, 6) as low, round(h.x, 6) as high from c join got l on l.id = 'l' || event_type || bucket join got h on h.id = 'h' || event_type || bucket""",
    "answers_apart": f"""with r as (select doc_id % 5 as bucket, (toxic = 1) = (quality = 0) as a, (doc_id % 7 = 0) = (quality = 0) as b from labels), c as (select bucket, count_if(a <> b) as pairs, count_if(a and not b) as only_a, count_if(b and not a) as only_b from r group by 1)
        select bucket, pairs, only_a, only_b, case when pairs > 0 then round({_BINOMIAL.format(k='only_a', n='pairs')}, 6) end as p from c""",
    "grader_table": f"""with recursive {_GRADED}, {_quantiles(_GRADED_ASK)},
        t as (select c.*, hits / nullif(flagged, 0) as precision, a / nullif(a + c, 0) as recall, ((a + b) * (a + c) + (c + d) * (b + d)) / (everything * everything) as chance, pl.x as pl, ph.x as ph, rl.x as rl, rh.x as rh from c
            join got pl on pl.id = 'pl' || bucket || grader join got ph on ph.id = 'ph' || bucket || grader join got rl on rl.id = 'rl' || bucket || grader join got rh on rh.id = 'rh' || bucket || grader)
        select bucket, grader, flagged, hits as "right", round(precision, 6) as precision, case when flagged > 0 then round(pl, 6) end as precision_low, case when flagged > 0 then round(ph, 6) end as precision_high, round(recall, 6) as recall,
            case when drawn > 0 then round(caught / greatest(census_wrong + rh * pool, 1e-9), 6) end as recall_low, case when drawn > 0 then round(caught / greatest(census_wrong + rl * pool, 1e-9), 6) end as recall_high,
            case when precision > 0 and recall > 0 then round(2 * precision * recall / (precision + recall), 6) end as f1, case when chance < 1 then round(((a + d) / everything - chance) / (1 - chance), 6) end as kappa, round(same / n, 6) as raw, round(same_w / everything, 6) as weighted from t""",
    "exact_tests": f"""with recursive {_arm_pairs('events', 'event_type', 'value', '')}, {_anova('events', 'event_type', 'value', '')}, {_signed('events', 'value - 30', '')},
        e as materialized (select count_if(event_type = 'error') as hits, count(*) as n from events where event_type in ('error', 'click')), {_quantiles("select 'jeffreys low' as id, 0.025 as p, hits + 0.5 as a, n - hits + 0.5 as b from e union all select 'jeffreys high', 0.975, hits + 0.5, n - hits + 0.5 from e", 6000)}
        select a || ' vs ' || b as name, round(least(1, tests * {_beta('dof / (dof + t * t)', 'dof / 2', '0.5', 12000)}), 6) as value from tested union all select 'anova', round({_beta('(n - arms) / ((n - arms) + (arms - 1) * f)', '(n - arms) / 2.0', '(arms - 1) / 2.0', 12000)}, 6) from f
        union all select 'signed rank', round({_normal('z')}, 6) from z union all select 'binomial', round({_BINOMIAL.format(k='hits', n='n')}, 6) from e union all select id, round(x, 6) from got""",
    "gap_reasons": """with g as (select l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_quantity': l_quantity, 'l_extendedprice': l_extendedprice, 'l_discount': l_discount}) as s from lineitem group by all), u as (select l_orderkey, l_linenumber, unnest(s) from g),
        l as (select *, l_partkey + l_linenumber as n, nullif(floor(l_quantity / 5) * 10, 0)::double as heat from u),
        m as (select *, case when n % 7 <> 0 then round(l_extendedprice / 20000) * 10 end as mass from l),
        r as (select l_orderkey * 1000 + l_linenumber as record, {'paper': l_suppkey, 'category': case n % 3 when 0 then 'both' when 1 then 'ours' else 'theirs' end, 'ours': 'zn' || l_partkey % 11, 'theirs': case when n % 13 <> 0 then 'zn' || l_partkey % 11 else '' end, 'oh': heat, 'th': heat * (1 + (n % 5) * 0.01::double), 'om': mass, 'tm': case when n % 2 = 0 then mass end, 'os': case when n % 5 <> 0 then round(l_discount * 50) end, 'ts': round(l_discount * 50)} as s from m),
        t as materialized (select record, unnest(s) from r), o as (select * from t where category = 'ours'), x as (select * from t where category <> 'ours'),
        near as (select o.record, x.category <> 'both' and abs(x.ts - o.os) <= 0.02 * greatest(abs(x.ts), abs(o.os), 1e-9) as listed from o join x on o.paper = x.paper and o.ours = x.theirs
            where (o.oh is not null and x.th is not null or o.om is not null and x.tm is not null) and coalesce(abs(o.oh - x.th) <= 0.02 * greatest(abs(o.oh), abs(x.th), 1e-9), true) and coalesce(abs(o.om - x.tm) <= 0.02 * greatest(abs(o.om), abs(x.tm), 1e-9), true)),
        f as (select record, coalesce(bool_or(listed), false) as listed from near group by 1),
        z as (select o.*, case when ours = 'zn3' then 'an excluded name'
            when exists (select 1 from t where t.category in ('both', 'ours') and t.record <> o.record and t.paper = o.paper and t.ours = o.ours and t.oh is not distinct from o.oh and t.om is not distinct from o.om and t.os is not distinct from o.os and (o.oh is not null or o.om is not null or o.os is not null)) then case when paper % 2 = 0 then 'a repeat of a run curated once' else 'the same run tabulated twice' end
            when not exists (select 1 from x where x.paper = o.paper and x.theirs = o.ours) then 'a name not curated' when f.listed then 'the same run, missed by the matcher' when f.record is not null then 'a repeat of a run curated once' else 'a condition not curated' end as reason from o left join f using (record))
        select paper, reason, count(*) as n, sum(record)::bigint as records from z group by 1, 2""",
    "sparse_assignment": f"""with recursive {_EXTRACTION}, {_MATCHINGS}, best as (select k, arg_min(m, cost) as m, min(cost) as cost, any_value(n) as n from made where r = n group by k)
        select k as l_orderkey, m as pairs, round(cost - 10 * (n - m), 6) as cost from best where m > 0""",
    "paired_rest": f"""with recursive {_EXTRACTION}, pairs as materialized (select a.l_orderkey as k, a.index as i, b.index // 7 as j, {_penalty('l_quantity')} / 2 as c from keys a join found b on a.l_orderkey = b.l_orderkey and a.p_name = b.p_name),
        {_MATCHINGS[_MATCHINGS.index('rows as materialized'):]}, best as (select k, arg_min(m, cost) as m from made where r = n group by k), a as (select l_orderkey, count(*) as a from keys group by 1), b as (select l_orderkey, count(*) as b from found group by 1)
        select l_orderkey, least(a, b) - coalesce(m, 0) as pairs from a join b using (l_orderkey) left join best on k = l_orderkey where least(a, b) > coalesce(m, 0)""",
    "equal_shares": """with o as (select o_orderkey, least(o_custkey % 40, 12) as field, (o_totalprice > 150000)::int as filled from orders), s as (select field, count(*) as n from o group by 1),
        lv as (select max(l) as l from range(0, 778) t(l) where (select sum(least(n, l)) from s) <= 777), q as (select field, n, least(n, l) + (n > l and row_number() over (order by n desc, field) <= 777 - sum(least(n, l)) over ())::int as quota from s, lv),
        r as (select *, row_number() over (partition by field order by filled desc, md5('5|' || o_orderkey), o_orderkey) as place from o)
        select field, count(*) as n, sum(o_orderkey)::bigint as orders, sum(r.filled)::bigint as filled from r join q using (field) where place <= quota group by 1""",
    "density_plane": """with c as materialized (select l_returnflag as f, floor(l_quantity * 20 / 60)::bigint as i, floor(l_extendedprice * 20 / 120000)::bigint as j, count(*) as n from lineitem group by all),
        m as (select l_returnflag as f, count(*) as t, var_samp(l_quantity) * pow(count(*), -1.0/3) as xx, var_samp(l_extendedprice) * pow(count(*), -1.0/3) as yy, covar_samp(l_quantity, l_extendedprice) * pow(count(*), -1.0/3) as xy from lineitem group by 1),
        e as (select f, i, j from (select f, min(i) - ceil(6 * sqrt(any_value(xx)) / 3)::bigint as i0, max(i) + ceil(6 * sqrt(any_value(xx)) / 3)::bigint as i1, min(j) - ceil(6 * sqrt(any_value(yy)) / 6000)::bigint as j0, max(j) + ceil(6 * sqrt(any_value(yy)) / 6000)::bigint as j1 from c join m using (f) group by f), range(-200, 200) a(i), range(-200, 200) b(j) where i between i0 and i1 and j between j0 and j1),
        w as (select e.f, e.i, e.j, c.n, (yy * pow((e.i - c.i) * 3, 2) - 2 * xy * (e.i - c.i) * 3 * (e.j - c.j) * 6000 + xx * pow((e.j - c.j) * 6000, 2)) / (xx * yy - xy * xy) as q, 2 * pi() * sqrt(xx * yy - xy * xy) * t as norm from e join c on e.f = c.f join m on m.f = c.f),
        d as materialized (select f, i, j, sum(n * exp(-q / 2) / norm) as density from w where q <= 36 group by all), p as (select d.*, coalesce(c.n, 0) as n from d left join c using (f, i, j)),
        l as (select f, quantile_cont(density, 0.1) as level from (select f, density, unnest(range(n)) from p where n > 0) group by f)
        select f as l_returnflag, i, j, n, round(density * 1e6, 6) as density, density >= level as inside from p join l using (f)""",
    "density_curve": """with v as (select event_type as t, value as v from events where value between 0 and 100), c as (select t, least(floor(v * 50 / 100), 49)::bigint as i, count(*) as n from v group by all), m as (select t, count(*) as a, sqrt(var_samp(v)) * pow(count(*), -0.2) as s from v group by 1 having var_samp(v) > 0)
        select t as event_type, g.i, 0.0 + (g.i + 0.5) * 2.0::double as at, round(sum(n * exp(-pow((g.i - c.i) * 2 / s, 2) / 2) / (sqrt(2 * pi()) * s * a)), 8) as density from c join m using (t), range(50) g(i) where abs(g.i - c.i) <= least(ceil(6 * s / 2), 50) group by all""",
    "eligible_records": """with l as (select l_returnflag, (l_quantity > 5)::int + (l_discount <> 0)::int + (l_tax <> 0)::int as filled from lineitem where l_returnflag <> 'R' and l_linenumber <> 3 and l_linenumber < 6) select filled, l_returnflag, count(*) as n from l where filled >= 2 group by all""",
    "decided_fresh": """with c as (select conv_id, role || turn % 2 as who, case when turn % 3 = 1 then null else turn % 3 = 0 end as carried from conversations), d as (select conv_id, case when conv_id % 4 <> 0 then list_sort(list(distinct who))[1:2] end as deciders from c group by 1),
        a as (select conv_id, who, bool_and(coalesce(carried, false)) as carried from c group by all), s as (select d.conv_id, bool_and(a.carried) as every from d join a on a.conv_id = d.conv_id and list_contains(d.deciders, a.who) group by 1)
        select conv_id, not coalesce(every, false) as fresh from d left join s using (conv_id)""",
    "name_kinds": """select case p_partkey % 5 when 0 then 'mixture of two' when 1 then 'code the paper coined' when 2 then 'supported on a carrier' else 'plain chemical name' end as kind, translate(replace(replace(lower(p_type), 'ac', 'oac'), 'ooac', 'oac'), ' []()', '') || 'oac' as substance, count(*) as n from part group by all""",
    "resolved_names": """with g as (select case p_partkey % 12 when 0 then upper(p_name) || ' dihydrate' when 1 then p_name || ' (99%)' when 2 then p_name || ' / hot ring' when 3 then p_name || ' + steel' when 4 then 'None' when 5 then 'N/A' when 6 then '  ' when 7 then '[' || p_name || ']' when 8 then lower(p_type) || ' zeolite' else p_name end as name,
            case when p_partkey % 12 in (4, 5, 6) then null when p_partkey % 12 = 8 then lower(p_type) || ' zeolite' else p_name end as bare, p_partkey % 12 as k from part),
        t as (select distinct p_name, p_name like 'old%' as oxide, case when length(p_name) % 4 <> 0 then upper(replace(p_name, ' ', '-')) end as value, case when length(p_name) % 8 = 0 then 'a material' else 'ambiguous' end as note from part where p_name not like 'blue%'),
        j as (select g.*, t.value, t.note, t.oxide, h.value as ring from g left join t on bare = t.p_name left join t h on h.p_name = 'hot ring' and not h.oxide),
        o as (select name, k, case when k = 6 then 'not reported' when k = 4 then 'unmappable: no catalyst was used' when k = 5 then 'unmappable: not reported'
                when k = 2 then case when not oxide and value is not null and ring is not null then 'mixture' else 'unknown: mixture with an unrecognised component' end when k = 3 then 'unknown: mixture with an unrecognised component'
                when not oxide and value is null then 'unmappable: ' || note when not oxide then 'lookup' when oxide and value is not null then 'lookup: an oxide' else 'unknown: name not in the lookup' end as origin, value, ring from j),
        v as (select name, origin, case when origin = 'mixture' then list_aggregate(list_sort([value, ring]), 'string_agg', '.') when origin like 'lookup%' then value end as value, case when k in (4, 5, 6) then 'nothing to map' when k in (3, 8) then 'no structure' else 'not yet mapped' end as mappable from o)
        select name, value, origin, mappable, case when origin = 'not reported' then 'not reported' when origin like 'unmappable%no catalyst%' then 'no catalyst' when origin like 'unmappable%' then 'not reported' when name like 'small%' then 'confirmed' when value is not null then 'LLM written' when mappable = 'no structure' then 'impossible' else 'unclear' end as tier, count(*) as n from v group by all""",
    "identity_checks": f"""with {_NAMED}, s as (select distinct solvent from r where solvent is not null), m as (select structure, count(distinct name) as m from r where structure is not null group by 1)
        select 'hydrate without water' as "check", count_if(regexp_matches(name, '(?i)H2O|hydrate|·\\s*\\d|\\.\\s*\\d\\s*H2O') and not regexp_matches(coalesce(structure, ''), '\\.O\\b|O\\.O')) as n, count_if(regexp_matches(name, '(?i)H2O|hydrate|·\\s*\\d|\\.\\s*\\d\\s*H2O')) as total from r
        union all select 'several in one cell', count_if(regexp_matches(name, '\\s/\\s|\\s\\+\\s|,\\s|\\sand\\s')), count(*) from r union all select 'loading in the name', count_if(regexp_matches(name, '\\d\\s*(%|wt|mol|M\\b|mM\\b)')), count(*) from r
        union all select 'unverified structure', count_if(source = 'LLM written'), count(*) from r union all select 'synonyms', count(distinct name) - count(distinct structure), count(distinct name) from r union all select 'structures of several names', count_if(m > 1), count(*) from m
        union all select 'solvent spellings', {' + '.join(f"count_if(regexp_matches(lower(trim(solvent)), '{p}')) - 1" for p in _FAMILIES)}, count(*) from s""",
    "inference_checks": f"""with {_NAMED}, f as (select *, case lower(solvent) when 'eg' then 'ethylene glycol' when 'deg' then 'diethylene glycol' when 'h2o' then 'water' when 'meoh' then 'methanol' else lower(solvent) end as full_name from r),
        t as (select *, coalesce(not regexp_matches(full_name, 'glycol|\\beg\\b|methanol|\\bmeoh\\b|water|aqueous|steam'), true) as other, regexp_matches(lower(solvent), 'glycol|\\beg\\b|diethylene')::int + regexp_matches(lower(solvent), 'methanol|\\bmeoh\\b')::int + regexp_matches(lower(solvent), 'water|aqueous|steam')::int as fired from f)
        select 'unseen abbreviation' as "check", count_if(solvent in ('DEG', 'H2O', 'PG', 'TEG', 'MEG', 'CH3OH', 'H₂O')) as n, count_if(other) as total from t union all select 'two rules fire', count_if(fired > 1), count(*) from t
        union all select 'no slot for the route', count_if(coalesce(regexp_matches(solvent, '(?i)^(ethanol|etanol|EtOH|\\d-?(butan|pentan|hexan|octan|propan)ol)'), false) or other and solvent is not null), count(*) from t union all select 'solid among the dissolved', count_if(regexp_matches(name, '(?i)\\bZnO\\b')), count(*) from t""",
    "reagent_bases": f"""with {_NAMED}, b as (select *, coalesce(regexp_matches(lower(name), '\\bk\\s*oh\\b|sodium hydroxide'), false) as base from r)
        select count_if(base) as records, count_if(coalesce(name, 'none') <> 'none') as named, (select round(median(part * 100 / whole), 6) from b where base and whole > 0) as median from b""",
    "answer_key_faults": """with l as (select l_orderkey as paper, l_returnflag || nullif(l_quantity::int % 3, 0) as name, case when l_quantity > 3 then l_quantity * 2.1::double end as y, case when l_tax > 0.01 then l_tax * 1300 - 20 end as c, l_discount - 0.01::double as mass, l_quantity::int % 7 = 0 or l_quantity::int % 3 = 0 as uncited from lineitem), d as (select count(*) as n from (select distinct paper, name, y, c, mass from l))
        select unnest(['papers', 'distinct names', 'experiments', 'entered twice', 'no outcome at all', 'percentage outside 0-100', 'negative amount', 'citing no source chunk']) as fault,
            unnest([count(distinct paper), count(distinct name), count(*), count(*) - (select n from d), count_if(y is null and c is null), count_if(y < 0 or y > 100) + count_if(c < 0 or c > 100), count_if(mass < 0) + count_if(c < 0), count_if(uncited)]) as n from l""",
    "implied_error": """with e as (select abs(l_quantity * 2 - nullif(l_discount, 0.0) * (l_tax * 1000) / 100) as e from lineitem) select count(e) as n, round(avg(e), 6) as mean, round(stddev_samp(e), 6) as std, round(min(e), 6) as min, round(quantile_cont(e, 0.25), 6) as p25, round(median(e), 6) as median, round(quantile_cont(e, 0.75), 6) as p75, round(max(e), 6) as max from e""",
    "modelable_core": f"with {_NAMED} select count_if(name is not null and structure is not null and solvent is not null) as rows, count(distinct case when name is not null and structure is not null and solvent is not null then nullif(p_partkey % 40, 7) end) as papers, count(*) as total from r",
    "check_evidence": f"""with {_NAMED}, h as (select 'heavy' as "check", p_partkey, name from r where part > 45 union all select 'base', p_partkey, name from r where regexp_matches(lower(name), '\\bk\\s*oh\\b|sodium hydroxide')), k as (select *, row_number() over (partition by "check" order by p_partkey) as place from h)
        select "check", place::int as place, case when name is null then '{{"p_partkey":' || p_partkey || '}}' else '{{"p_partkey":' || p_partkey || ',"name":"' || name || '"}}' end as "row" from k where place <= 4""",
    "empty_paper_reasons": """with d as (select lower(left(text, 400)) as t from documents where doc_id % 3 <> 0)
        select case when regexp_matches(t, 'enzym|petase|cutinase|hydrolase|esterase|lipase|bacter|microb|biolog|biodegrad|fungal|biocatal|whole-cell|coli') then 'enzymatic or biological' when regexp_matches(t, '\\breview\\b|recent advance|advances in|perspective|outlook|progress in|state of the art') then 'review article'
            when regexp_matches(t, 'pyrolys|incinerat|combust|gasific|composite|membrane|fib(er|re)|elastomer|resin|coating|adsorb|electrode|microplastic|migration|copolyester|nanocage') then 'other route or material' else 'no extractable data' end as reason, count(*) as n from d group by 1""",
    "reproduced_scores": "select doc_id % 6 as bucket, doc_id % 6 not in (2, 4) as ok from labels group by all",
    "judge_matrix": """with l as (select e, o_custkey, o_orderkey, o_orderstatus = 'F' or e = 'y' and o_orderkey % 5 = 0 as m, o_orderkey % 4 <> 0 as v from orders, (values ('x'), ('y')) t(e)),
        j as (select judge, e, o_custkey, o_orderkey, o_orderpriority < '3' or judge = 'b' as s from orders, (values ('a', 'x'), ('b', 'x'), ('a', 'y'), ('a', 'z')) t(judge, e) where o_orderkey % 7 <> 12 % 7)
        select judge, e as extraction, count(*) as records, round(count_if(m = s) / count(*), 6) as agreement, count_if(v) as evaluable, round(count_if(v and m = s) / count_if(v), 6) as agreement_evaluable, count_if(v and m = s) as agree, count_if(v and m <> s) as disagree, count_if(not v) as no_counterpart from l join j using (e, o_custkey, o_orderkey) group by all""",
    "verdict_changelog": """with e as (select event_id, event_type, value, try_cast(json_extract_string(props, '$.k') as double) as k, event_id % 7 <> 0 as ok, event_id % 11 = 0 as gone, coalesce(case when event_id % 5 <> 0 then event_type end, '') as critique, case when event_id % 2 = 0 then value end as back from events),
        f as (select * from e where event_id % 3 = 0 and ok and not gone)
        select event_id, 'dropped' as action, critique, null as field, null as evidence, null as "to" from e where event_id % 3 <> 1 and ok and gone
        union all select event_id, 'repaired', critique, 'value', 'table', round(k, 6) from f where value is distinct from k union all select event_id, 'repaired', critique, 'value', 'figure', round(back, 6) from f where k is distinct from back
        union all select event_id, 'repaired', critique, 'event_type', 'text', null from f where event_type <> 'fixed'
        union all select event_id, 'kept', case when ok then 'fixed' else event_type end, null, null, round(case when ok then back else value end, 6) from e where event_id % 3 = 0 and not (ok and gone)""",
    "correction_outcomes": """with o as (select case when o_custkey % 4 = 0 and o_custkey % 5 <> 0 then 'fill' when o_custkey % 4 <> 0 and o_custkey % 5 = 0 then 'empty' when o_orderkey % 3 = 0 then 'substance' else 'number' end as kind, o_orderpriority < '3' as b, o_orderstatus = 'F' as j, o_orderkey % 7 = 0 as n from orders)
        select kind, count_if(j and not b) as caught, count_if(b) as both, count_if(n and not j and not b) as rejected, count(*) as cases, round(count_if(j and not b) / count(*), 6) as share from o where b or j or n group by 1""",
    "chunk_documents": f"""with s as (select doc_id, text, list_transform({SENTENCES}, lambda x: {{'done': []::varchar[], 'open': x}}) as s, length(text) <= 2800 or starts_with(ltrim(text), '|') or contains(text, chr(10) || '| ') as whole from documents where trim(text) <> ''),
        r as (select doc_id, case when whole then [text] else (select list_append(r.done, r.open) from (select list_reduce(s, lambda a, x: case when length(a.open) + 1 + length(x.open) <= 2800 then {{'done': a.done, 'open': a.open || ' ' || x.open}} else {{'done': list_append(a.done, a.open), 'open': x.open}} end) as r)) end as c from s),
        u as (select doc_id, unnest(range(len(c)))::int as pos, unnest(c) as text from r), h as (select *, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::blob || encode(doc_id || '|' || pos || '|' || left(text, 200))) as h from u)
        select doc_id, pos, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::int % 4) + 1, 1) || h[18:20] || '-' || h[21:32] as chunk_id, text from h""",
    "even_rolling_median": 'select event_id, round(case when count(value) over w >= 10 then quantile_cont(value, 0.5) over w end, 6) as rolling_median from events window w as (partition by event_type order by ts, event_id rows between 10 preceding and 9 following)',
    "coerced_numbers": "select p_partkey, case p_partkey % 5 when 0 then p_size::DOUBLE when 1 then cast(p_size || 'e-05' as DOUBLE) when 2 then -(p_size + 0.5::DOUBLE) when 3 then null else p_size::DOUBLE end as value, case p_partkey % 5 when 0 then p_size || ' c' when 1 then p_size || 'e-05' when 2 then p_size || '.5 g' when 3 then 'none' else p_size::VARCHAR end as name from part",
    "field_agreement": "select 'q' as field, count(*) as n, round(avg((abs(l_quantity - (l_quantity + (l_suppkey % 3) * 0.004::DOUBLE)) <= 0.01)::INT), 6) as agree from lineitem union all select 'f', count(*), round(avg((l_linestatus = 'O')::INT), 6) from lineitem where l_partkey % 7 <> 0",
    "condition_points": 'select p_size - 25 as x, count(*) as n, round(avg(log10(y)), 6) as y from (select p_size, p_retailprice - p_partkey % 3 * 1000 as y from part) where y > 0 group by p_size',
    "runner_up": "with a as (select o_orderpriority as arm, avg(o_totalprice) as m, min(o_totalprice) as lo, max(o_totalprice) as hi from orders where o_orderstatus = 'F' group by 1), t as (select *, row_number() over (order by m desc, arm) as p from a) select max(case when p = 1 then arm end) as best, max(case when p = 2 then arm end) as second, round(least(max(case when p = 1 then lo end), max(case when p = 2 then hi end)), 6) as meet from t where p <= 2",
    "phase_cascade": "select label, reason, decided_by, count(*) as n from (select unnest(case when p_size = 1 then {'label': 'uncatalysed', 'reason': 'none reported', 'decided_by': 'tier'} when p_name in ('red bolt', 'blue ring') then {'label': 'heterogeneous', 'reason': 'decided by hand', 'decided_by': 'curated'} when regexp_matches(p_name, 'bolt|nut') then {'label': 'heterogeneous', 'reason': 'a solid', 'decided_by': 'solid'} when p_name like '%ring%' then {'label': 'homogeneous', 'reason': 'dissolves', 'decided_by': 'soluble'} else {'label': 'unknown', 'reason': 'no rule matched', 'decided_by': 'none'} end) from part) group by 1, 2, 3",
    "release_build": "select p_partkey, case when regexp_matches(p_brand, '[13]$') then 'homogeneous' else 'uncatalysed' end as phase, case when p_partkey % 4 <> 0 then p_name end as p_name, case when p_partkey % 9 <> 0 then round(p_size / p_retailprice, 4) end as loading, p_partkey % 4 <> 0 as single_component, case when length(p_type) % 2 <> 0 then 'molar' end as basis from part where regexp_matches(p_brand, '[135]$')",
    "mechanical_checks": "with l as (select l_partkey, l_suppkey, case when l_quantity < 48 then l_quantity * 2.2::DOUBLE end as y, case when l_tax > 0.01 then l_tax * 1300 end as c, l_discount as part, l_quantity - 1 as whole, l_extendedprice / 200 as heat, nullif((l_quantity - 5) * 250, 2500) as time from lineitem) select 'no time or over a week' as check, count(*) filter (time <= 0 or time > 10080) as n, count(time) as total from l union all select 'no outcome', count(*) filter (y is null and c is null), count(*) from l union all select 'incomplete', count(*) filter (y is null or heat is null), count(*) from l union all select 'above 100%', count(*) filter (y > 100 or c > 100), count(*) from l union all select 'yield above conversion', count(*) filter (y > c + 1), count(*) filter (y is not null and c is not null) from l union all select 'absurd amounts', count(*) filter (y > 105 or part > 0.095), count(*) from l union all select 'part outweighs whole', count(*) filter (whole > 0 and part / whole > 1), count(*) filter (whole > 0 and part is not null) from l union all select 'too hot', count(*) filter (heat > 350), count(heat) from l union all select 'repeated', count(*) - (select count(*) from (select distinct l_partkey, l_suppkey from l)), count(*) from l",
    "screen_reasons": "select coalesce(reason is null, true) as keep, coalesce(reason, 'keep') as reason, count(*) as n from (select case when coalesce(length(text), 0) = 0 then 'no text' when n_chars < 300 then 'short' when lang <> 'en' then 'other language' end as reason from documents) group by 1, 2",
    "evaluable_agreement": """with l as (select doc_id % 4 as bucket, coalesce((quality = 1) = (toxic = 0), false) as s, doc_id % 3 <> 0 as e from labels)
        select bucket, count(*) as records, count_if(e) as evaluable, count_if(s and e) as agree, round(count_if(s) / count(*), 6) as agreement, round(count_if(s and e) / nullif(count_if(e), 0), 6) as agreement_evaluable,
            count_if(e and not s) as disagree, count_if(not e) as no_counterpart from l group by 1""",
    "annotator_overlap": """with a as (select o_orderkey as k, o_orderstatus as h, o_custkey % 3 = 0 as c from orders where o_orderkey % 2 = 0), b as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'F' else o_orderstatus end as h, o_custkey % 2 = 0 as c from orders where o_orderkey % 3 = 0),
        s as (select a.h is not distinct from b.h as same, a.c as ac, b.c as bc from a join b using (k))
        select (select count(*) from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0) as total, count(*) as shared, count_if(ac and bc) as carried_by_both, count_if(not ac and not bc) as independent, round(count_if(same) / count(*), 6) as agreement from s""",
    "reach_by_kind": """with n as (select c_mktsegment, c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by all)
        select c_mktsegment, count(*) as units, count_if(n > 0) as yielding, sum(n)::bigint as rows, round_even(100.0 * count_if(n > 0) / count(*), 0)::double as percent from n group by 1""",
    "pass_rates_by_kind": "select o_orderpriority, count(*) as records, count_if(o_orderstatus = 'F') as changed, round(100 - 100 * count_if(o_orderstatus = 'F') / count(*), 1) as pass_rate from orders group by 1",
    "case_tolerant_keys": """with t as (select lower(p_type) as kind, count(*) as n from part group by 1), u as (select * from t union all select upper(kind), -n from t where n % 2 = 0),
        g as (select p_partkey, case p_size % 3 when 0 then upper(p_type) when 1 then p_type || '?' else lower(p_type) end as kind from part)
        select p_partkey, g.kind, coalesce(a.n, b.n) as n from g left join u a on g.kind = a.kind left join u b on lower(g.kind) = b.kind""",
}
