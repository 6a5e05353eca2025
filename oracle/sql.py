"""SQL over the given tables, one statement per query that SQL can express."""

from __future__ import annotations

from barloom.plans.features import BASELINE_NAMES, FEATURE_NAMES, INTERMEDIATE_NAMES
from barloom.sources.schema import BAR_COLUMNS
from oracle.rounding import digits

KEY = 'symbol, date, "interval"'

BARS = """
b as (
  select cast(90000000 + user_id // 15 as bigint) symbol,
    cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as int) date,
    cast(hour(ts) * 10000 as bigint) "interval",
    arg_min(value, ts) open, max(value) high, min(value) low, arg_max(value, ts) lastpx,
    min(value) bid0, max(value) + 0.01::double ask0,
    cast(sum(case when event_type = 'purchase' then cast(floor(value) as bigint) else 0 end) as double) tradeBuyQty,
    cast(sum(case when event_type = 'click' then cast(floor(value) as bigint) else 0 end) as double) tradeSellQty,
    cast(sum(case when event_type = 'view' then 1 else 0 end) as double) asize0,
    cast(sum(case when event_type = 'error' then 1 else 0 end) as double) bsize0,
    cast(sum(case when event_type = 'view' then cast(floor(value) as bigint) else 0 end) as double) asize0_4,
    cast(sum(case when event_type = 'error' then cast(floor(value) as bigint) else 0 end) as double) bsize0_4,
    cast(sum(case when event_type in ('view', 'click') then 1 else 0 end) as double) asize5_9,
    cast(sum(case when event_type in ('error', 'purchase') then 1 else 0 end) as double) bsize5_9,
    cast(sum(case when event_type = 'signup' then 1 else 0 end) as double) cxlSellQty,
    cast(sum(case when event_type = 'signup' then cast(floor(value) as bigint) else 0 end) as double) cxlSellTurnover,
    max(case when event_type = 'signup' then value end) cxlSellHigh
  from events group by 1, 2, 3),
m as (select *, (bid0 + ask0) / 2 midpx from b),
bars as (select *, lead(midpx, 12) over (partition by symbol order by date, "interval") / nullif(midpx, 0) - 1 fret12 from m)
"""

BAR_SELECT = f"{KEY}, {', '.join(BAR_COLUMNS)}, fret12"


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif(({b}) + 1e-9, 0)"


def _imb(a: str, b: str, guard: bool = True) -> str:
    return _div(f"{a} - {b}", f"{a} + {b}") if guard else f"({a} - {b}) / nullif({a} + {b}, 0)"


def _log(x: str) -> str:
    return f"case when coalesce({x}, 0) > -1 then ln(1 + coalesce({x}, 0)) end"


def _full(x: str, e: str) -> str:
    return f"case when count({x}) over w5 = 5 then {e} end"


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) over w"


def _ewm(source: str, out: str, column: str, decay: str) -> str:
    """Direct weighted sums over all earlier rows of the symbol."""
    return f"""{out}_t as (
  select y.symbol, y.date, y."interval",
    sum(x.{column} * pow({decay}, y.rn - x.rn)) / nullif(sum(case when x.{column} is not null then pow({decay}, y.rn - x.rn) end), 0) {out}
  from {source} y join {source} x on x.symbol = y.symbol and x.rn <= y.rn group by 1, 2, 3)"""


HALF5, SPAN30 = "pow(0.5::double, 0.2::double)", "(29::double / 31)"
PRICES = ("midpx", "high", "low", "open", "lastpx")
EWM = {"trade_imbema5": ("trade_imb", HALF5), "ema_trade_imb": ("trade_imb", SPAN30), **{f"ema_{c}": (c, SPAN30) for c in PRICES}}

BOOK = {"ob_imb0": ("asize0", "bsize0"), "ob_imb4": ("asize0_4", "bsize0_4"), "ob_imb9": ("asize5_9", "bsize5_9")}
RATIOS = {
    "ratio_high_low": ("high", "low"), "ratio_open_close": ("open", "lastpx"), "ratio_midpx_open": ("midpx", "open"),
    "ratio_lastpx_midpx": ("lastpx", "midpx"), "ratio_tradeBuyQty_tradeSellQty": ("tradeBuyQty", "tradeSellQty"),
    "ratio_high_bid0": ("high", "bid0"), "ratio_ask0_open": ("ask0", "open"), "ratio_lastpx_bid0": ("lastpx", "bid0"),
    "ratio_bid_ask": ("bid0", "ask0"), "ratio_high_ask0": ("high", "ask0"), "ratio_low_bid0": ("low", "bid0"),
}
GAPS = {
    "diff_high_low": ("high", "low"), "spread_high_low": ("high", "low"), "diff_open_close": ("open", "lastpx"),
    "diff_midpx_open": ("midpx", "open"), "diff_lastpx_midpx": ("lastpx", "midpx"), "diff_bid0_ask0": ("bid0", "ask0"),
    "spread_bid_ask": ("ask0", "bid0"),
}


def _expressions() -> dict[str, str]:
    """Feature name -> SQL over ``e`` with windows w and w5; null-fill comes later."""
    e = {n: _imb(*s) for n, s in BOOK.items()}
    e |= {n: n for n in ("trade_imb", "log_midpx", "bret12", "cx_bret12", "cxlSellHigh", "cxlSellTurnover", "cxlSellQty", *EWM)}
    e["lagret12"] = "bret12 - cx_bret12"
    e |= {f"trend_{c}": f"{c} - {_lag(c, 1)}" for c in (*PRICES, "tradeBuyQty", "tradeSellQty")}
    e |= {n: f"{a} - {b}" for n, (a, b) in GAPS.items()}
    e |= {n: _div(a, b) for n, (a, b) in RATIOS.items()}
    e |= {f"log_{c}": _log(c) for c in ("high", "low", "open", "lastpx", "tradeBuyQty", "tradeSellQty", "ask0", "bid0", "trade_imbema5")}
    e |= {f"log_{n}": _log(_imb(*BOOK[n])) for n in ("ob_imb0", "ob_imb4")}
    e["log_lagret12"] = _log("bret12 - cx_bret12")
    e |= {f"moving_avg_{c}_5": _full(c, f"avg({c}) over w5") for c in (*PRICES, "tradeBuyQty", "tradeSellQty")}
    e |= {f"rolling_mean_{c}_5": _full(c, f"avg({c}) over w5") for c in ("midpx", "tradeBuyQty", "tradeSellQty")}
    e["mean_midpx_last_N"] = _full("midpx", "avg(midpx) over w5")
    e["max_midpx_last_N"] = _full("midpx", "max(midpx) over w5")
    e["min_midpx_last_N"] = _full("midpx", "min(midpx) over w5")
    e["rolling_std_midpx_5"] = e["volatility_midpx_5"] = _full("midpx", "stddev_samp(midpx) over w5")
    e["rolling_skew_midpx_5"] = _full("midpx", "coalesce(skewness(midpx) over w5, 0)")
    e["rolling_kurt_midpx_5"] = _full("midpx", "coalesce(kurtosis(midpx) over w5, -3)")
    e["volatility_log_midpx"] = _full("log_midpx", "stddev_samp(log_midpx) over w5")
    e["volatility_high_low"] = f"{_full('high', 'stddev_samp(high) over w5')} - {_full('low', 'stddev_samp(low) over w5')}"
    e["product_midpx_tradeBuyQty"] = "midpx * tradeBuyQty"
    e["momentum_midpx"] = f"midpx - {_lag('midpx', 5)}"
    e["momentum_trade_imb"] = f"trade_imb - {_lag('trade_imb', 5)}"
    e["momentum_log_midpx"] = f"log_midpx - {_lag('log_midpx', 1)}"
    return e


def _rounded(name: str, expression: str) -> str:
    d = digits(name)
    return f"round({expression}, {d}) + 0::double as {name}" if d is not None else f"{expression} as {name}"


def features_ctes(names, scope: str = "symbol", source: str = "bars") -> str:
    """CTEs ending in ``f``: key, names (0-filled) and label, from the bars in ``source``."""
    needed = [out for out in EWM if any(out in n for n in names)]
    group = "symbol, \"interval\"" if scope == "symbol" else '"interval"'
    joins = " ".join(f"join {out}_t using ({KEY})" for out in needed)
    expr = _expressions()
    return f"""
s as (select *, {_imb('tradeBuyQty', 'tradeSellQty')} trade_imb, {_log('midpx')} log_midpx,
  row_number() over w rn, {_div(f'midpx - {_lag("midpx", 12)}', _lag('midpx', 12))} bret12
  from {source} window w as (partition by symbol order by date, "interval")),
{"".join(_ewm('s', out, *EWM[out]) + ',' for out in needed)}
c as (select *, avg(bret12) over (partition by {group}) cx_bret12 from s),
e as (select * from c {joins}),
v as (select {KEY}, {', '.join(f'{expr[n]} as {n}' for n in names)}, fret12 from e
  window w as (partition by symbol order by date, "interval"),
         w5 as (partition by symbol order by date, "interval" rows between 4 preceding and current row)),
f as (select {KEY}, {', '.join(f'coalesce({n}, 0) as {n}' for n in names)}, coalesce(fret12, 0) fret12 from v)"""


def features_sql(names, scope: str = "symbol") -> str:
    return f"with {BARS}, {features_ctes(names, scope)} select {KEY}, {', '.join(_rounded(n, n) for n in names)}, fret12 from f"


def baseline_sql(rounded: bool = True) -> str:
    values = {n: _imb(*s, guard=False) for n, s in BOOK.items()}
    values |= {"trade_imb": "trade_imb", "trade_imbema5": "trade_imbema5", "lagret12": "bret12 - cx_bret12"}
    return f"""with {BARS},
s as (select *, {_imb('tradeBuyQty', 'tradeSellQty', guard=False)} trade_imb, row_number() over w rn,
  (midpx - {_lag('midpx', 12)}) / nullif({_lag('midpx', 12)}, 0) bret12
  from bars window w as (partition by symbol order by date, "interval")),
{_ewm('s', 'trade_imbema5', 'trade_imb', HALF5)},
e as (select *, avg(bret12) over (partition by "interval") cx_bret12 from s join trade_imbema5_t using ({KEY}))
select {KEY}, {', '.join(_rounded(n, f'coalesce({values[n]}, 0)') if rounded else f'coalesce({values[n]}, 0) {n}' for n in BASELINE_NAMES)},
  coalesce(fret12, 0) fret12 from e"""


# -- calendar ---------------------------------------------------------------------------

CALENDAR = """
cal as (select d, row_number() over (order by d) - 1 i from (
  select distinct cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int) d
  from orders where isodow(o_orderdate) <= 5)),
probe as (select l_orderkey, l_linenumber,
  cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as int) date from lineitem),
dates as (select p.date, (select count(*) from cal where d < p.date) lo, (select count(*) from cal where d <= p.date) hi
  from (select distinct date from probe) p)
"""


def calendar_sql(out: str, value: str, on: str = "") -> str:
    """``value`` over dates (lo, hi) joined to the day ``cal.i = on`` where given."""
    join = f"left join cal on cal.i = {on}" if on else ""
    return f"""with {CALENDAR}, looked as (select dates.date, {value} as {out} from dates {join})
select l_orderkey, l_linenumber, date, {out} from probe join looked using (date)"""


def calendar_list_sql(out: str, condition: str) -> str:
    return f"""with {CALENDAR}, looked as (select dates.date, cal.d as {out} from dates join cal on {condition})
select l_orderkey, l_linenumber, date, {out} from probe join looked using (date)"""


# -- models and metrics -------------------------------------------------------------------

METRICS = """select round(corr(forecast, fret12), 6) + 0::double pcor,
  round(1 - sum((forecast - fret12) * (forecast - fret12)) / nullif(var_samp(fret12), 0) / count(*), 6) + 0::double r2,
  round(sum((forecast - fret12) * (forecast - fret12)) / count(*), 6) + 0::double mse, count(*) n"""


def ridge_ctes(train: str, test: str, a: str, b: str) -> str:
    """CTE ``p``: forecasts of a two-feature ridge by Cramer's rule on the normal equations."""
    return f"""
g as (select sum({a} * {a}) + 0.5::double aa, sum({b} * {b}) + 0.5::double bb, sum({a} * {b}) ab,
  sum({a} * fret12) ay, sum({b} * fret12) yb from {train}),
w as (select (ay * bb - yb * ab) / (aa * bb - ab * ab) wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) wb from g),
p as (select {KEY}, {a} * wa + {b} * wb as forecast, fret12 from {test}, w)"""


def solved_ctes(train: str, test: str, names, alpha: float = 0.5) -> str:
    """CTE ``p``: forecasts of a ridge on any number of features, the normal equations solved by elimination."""
    n = len(names)
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    sums = ", ".join(f"sum({names[i]} * {names[j] if j < n else 'fret12'}){f' + {alpha}::double' if i == j else ''} a{i}_{j}" for i, j in cells)
    steps = [f"e0 as (select {sums} from {train})"]
    for k in range(n):
        row = [f"a{k}_{j} / a{k}_{k} a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} a{i}_{j}" for i, j in cells]
        steps.append(f"e{k + 1} as (select {', '.join(row)} from e{k})")
    forecast = " + ".join(f"{c} * a{i}_{n}" for i, c in enumerate(names))
    return ",\n".join(steps) + f",\np as (select {KEY}, {forecast} as forecast, fret12 from {test}, e{n})"


INFINITE = """
infinite as (select * replace (
  case when asize0 = 0 then 'inf'::double else high end as high, case when bsize0 = 0 then '-inf'::double else low end as low,
  case when cxlSellQty > 1 then 'nan'::double else open end as open) from bars)"""

LONG = f"""
src as (select case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end::bigint symbol,
  cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as int) date, epoch_us(ts) "interval",
  case when user_id % 4 <> 0 then value end x, row_number() over (partition by event_type order by ts) rn from events)"""

# -- exploration --------------------------------------------------------------------------

NUMERIC = ("symbol", '"interval"', "date", *BAR_COLUMNS, "fret12")
VALUES = (*BAR_COLUMNS, "fret12")

CLEAN = f"""
l as (select * from bars where not coalesce("interval" % 1000000 between 113000 and 130000, false)),
z as (select {KEY}, {', '.join(f'coalesce(last_value({c} ignore nulls) over w, first_value({c} ignore nulls) over a) {c}' for c in VALUES)}
  from l window w as (partition by symbol order by date, "interval" rows between unbounded preceding and current row),
    a as (partition by symbol order by date, "interval" rows between unbounded preceding and unbounded following)),
k as (select {KEY}, {', '.join(f'coalesce({c}, avg({c}) over ()) {c}' for c in VALUES)} from z)
"""


def per_column(template: str, columns=NUMERIC, source: str = "bars") -> str:
    return " union all ".join(template.format(c=c, name=c.strip('"'), source=source) for c in columns)


INFO_TYPES = {"symbol": "bigint", "interval": "bigint", "date": "int"}


def info_sql() -> str:
    parts = [
        f"""select '{c.strip('"')}' as "column", '{INFO_TYPES.get(c.strip('"'), 'double')}' as dtype, count({c}) as non_null from bars"""
        for c in NUMERIC
    ]
    return f"with {BARS} " + " union all ".join(parts)


DESCRIBE = """select '{name}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
  round(min({c})::double, 6) as min, round(quantile_cont({c}::double, 0.25), 6) as p25, round(quantile_cont({c}::double, 0.5), 6) as p50,
  round(quantile_cont({c}::double, 0.75), 6) as p75, round(max({c})::double, 6) as max from bars"""

HISTOGRAM = """select * from (
  with r as (select case when min({c}) = max({c}) then min({c}) - 0.5::double else min({c})::double end lo,
                    case when min({c}) = max({c}) then max({c}) + 0.5::double else max({c})::double end hi from bars),
  s as (select lo, hi, (hi - lo) / 20 step from r),
  v as (select {c}::double v, lo, step, least(cast(floor(({c}::double - lo) / step) as int), 19) b from bars, s where {c} is not null),
  n as (select b - case when v < lo + b * step then 1 else 0 end
             + case when v >= lo + (b + 1) * step and b < 19 then 1 else 0 end as bin, count(*) n from v group by 1)
  select '{name}' as "column", cast(g.bin as int) as bin, round(lo + g.bin * step, 6) as left,
    round(case when g.bin = 19 then hi else lo + (g.bin + 1) * step end, 6) as right, coalesce(n.n, 0) as n
  from s, range(20) g(bin) left join n on n.bin = g.bin)"""

BOX = """select * from (
  with q as (select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.5) q2, quantile_cont({c}, 0.75) q3 from bars)
  select '{name}' as "column", round(any_value(q1), 6) q1, round(any_value(q2), 6) median, round(any_value(q3), 6) q3,
    round(least(min(case when {c} >= q1 - 1.5 * (q3 - q1) then {c} end), any_value(q1)), 6) whisker_low,
    round(greatest(max(case when {c} <= q3 + 1.5 * (q3 - q1) then {c} end), any_value(q3)), 6) whisker_high,
    count(case when {c} < q1 - 1.5 * (q3 - q1) then 1 end) outliers_low,
    count(case when {c} > q3 + 1.5 * (q3 - q1) then 1 end) outliers_high
  from bars, q)"""

MISSING = """select '{name}' as "column", coalesce(bool_or({c} is null or isnan({c}::double)), false) as has_null,
  coalesce(bool_or(isinf({c}::double)), false) as has_inf from {source}"""

MINMAX = f"""
mm as (select {KEY}, {', '.join(f'coalesce(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 0) {c}' for c in VALUES)} from k)
"""

PCA2 = f"""with {BARS}, {CLEAN}, {MINMAX},
g as (select var_samp(midpx) a, covar_samp(midpx, tradeBuyQty) b, var_samp(tradeBuyQty) c from mm),
roots as (select *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) l2 from g),
u as (select b / sqrt(b * b + pow(l1 - a, 2)) x1, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) y1,
             b / sqrt(b * b + pow(l2 - a, 2)) x2, (l2 - a) / sqrt(b * b + pow(l2 - a, 2)) y2 from roots),
o as (select x1 * s1 x1, y1 * s1 y1, x2 * s2 x2, y2 * s2 y2 from (
  select *, sign(case when abs(x1) >= abs(y1) then x1 else y1 end) s1, sign(case when abs(x2) >= abs(y2) then x2 else y2 end) s2 from u))
"""


SQUARINGS = 14  # powers of the covariance up to 2 ** 14 leave its first direction only


def components_ctes() -> str:
    """CTE ``pcs``: feature, PC1, PC2 of the scaled columns, by repeated squaring of the covariance and one deflation."""
    long = " union all ".join(f"select rn, '{c}' f, {c} x from numbered" for c in VALUES)
    ctes = [f"numbered as (select row_number() over () rn, * from mm)", f"long as ({long})",
            "centred as (select rn, f, x - avg(x) over (partition by f) x from long)",
            "cov1 as (select a.f i, b.f j, sum(a.x * b.x) / (count(*) - 1) v from centred a join centred b on a.rn = b.rn group by 1, 2)"]
    for c in (1, 2):
        ctes.append(f"s{c}_0 as (select * from cov{c})")
        for k in range(SQUARINGS):
            ctes.append(f"s{c}_{k + 1} as (select a.i, b.j, sum(a.v * b.v) / (select pow(sum(v), 2) from s{c}_{k} where i = j) v"
                        f" from s{c}_{k} a join s{c}_{k} b on a.j = b.i group by 1, 2)")
        last = f"s{c}_{SQUARINGS}"
        ctes += [
            f"column{c} as (select i, v from {last} where j = (select arg_max(i, v) from {last} where i = j))",
            f"top{c} as (select i, v / (select sqrt(sum(v * v)) from column{c}) * (select sign(arg_max(v, abs(v))) from column{c}) v from column{c})",
            f"root{c} as (select sum(a.v * m.v * b.v) l from top{c} a join cov{c} m on a.i = m.i join top{c} b on b.i = m.j)"]
        if c == 1:
            ctes.append("cov2 as (select m.i, m.j, m.v - l * a.v * b.v v from cov1 m join top1 a on a.i = m.i join top1 b on b.i = m.j, root1)")
    ctes.append('pcs as (select top1.i feature, top1.v "PC1", top2.v "PC2" from top1 join top2 using (i))')
    return ",\n".join(ctes)


def all_sql(families: dict[str, list[str]], infinite: list[str]) -> dict[str, str]:
    shift = "case when lo > 0 and lo + ({n}) >= 0 then d end"
    sql = {
        "bars_from_events": f"with {BARS} select {BAR_SELECT} from bars",
        "bars_range_scan": f"with {BARS} select {BAR_SELECT} from bars where date between 20240106 and 20240117 and isodow(strptime(date::varchar, '%Y%m%d')) <= 5",
        "bars_day_scan": f"with {BARS} select {BAR_SELECT} from bars where date = 20240110",
        "symbol_scan": f"with {BARS} select {BAR_SELECT} from bars where symbol = 90000000",
        "cal_is_trading_day": calendar_sql("is_trading_day", "lo <> hi"),
        "cal_roll_forward": calendar_sql("trading_day", "d", "lo"),
        "cal_next": calendar_sql("next_day", "d", "hi"),
        "cal_prev": calendar_sql("prev_day", "d", "lo - 1"),
        "cal_shift": calendar_sql("shifted_day", shift.format(n=-3), "lo - 3"),
        "cal_shift_ahead": calendar_sql("shifted_day", shift.format(n=4), "lo + 4"),
        "cal_prevn": calendar_list_sql("prev_day", "cal.i >= lo - 3 and cal.i < lo"),
        "cal_nextn": calendar_list_sql("next_day", "cal.i >= hi and cal.i < hi + 3"),
        "cal_range": f"with {CALENDAR} select d trading_day, cast(i as int) idx from cal where d between 19960301 and 19980615",
        "features_all": features_sql(FEATURE_NAMES),
        "features_blocked": features_sql(FEATURE_NAMES),
        "features_intermediate": features_sql(INTERMEDIATE_NAMES),
        "features_baseline": baseline_sql(),
        "feat_lagret_universe": features_sql(["lagret12"], "universe"),
        "features_label_drop": f"with {BARS}, {features_ctes(['ob_imb0', 'momentum_midpx', 'ema_midpx'])} "
        f"select {KEY}, ob_imb0, momentum_midpx, {_rounded('ema_midpx', 'ema_midpx')}, f.fret12 from f join bars using ({KEY}) where bars.fret12 is not null",
        "eval_metrics": f"with {BARS}, {features_ctes(['lagret12'])} {METRICS} from (select lagret12 forecast, fret12 from f)",
        "ridge_two_features": f"with {BARS}, {features_ctes(['ob_imb0', 'trade_imb'])}, {ridge_ctes('f', 'f', 'ob_imb0', 'trade_imb')} "
        f"select {KEY}, round(forecast, 6) + 0::double forecast, fret12 from p",
        # The label of the last bars of a range comes from the whole table, as files carry it.
        "engine_fit_eval": f"""with {BARS}, {features_ctes(['ob_imb0', 'trade_imb'])},
f_train as (select * from f where date between 20240101 and 20240120),
f_test as (select * from f where date between 20240121 and 20240131),
{ridge_ctes('f_train', 'f_test', 'ob_imb0', 'trade_imb')} {METRICS} from p""",
        "ridge_baseline": f"with base as ({baseline_sql(rounded=False)}), {solved_ctes('base', 'base', BASELINE_NAMES)} "
        f"select {KEY}, round(forecast, 6) + 0::double forecast, fret12 from p",
        "feat_ewm_long": f"""with {LONG}, {_ewm('src', 'by_halflife', 'x', HALF5)}, {_ewm('src', 'by_span', 'x', SPAN30)}
select {KEY}, round(by_halflife, 6) + 0::double by_halflife, round(by_span, 6) + 0::double by_span from by_halflife_t join by_span_t using ({KEY})""",
        "feat_infinite_prices": f"with {BARS}, {INFINITE}, finite as (select * replace ("
        + ", ".join(f"case when isfinite({c}) then {c} end as {c}" for c in ("high", "low", "open"))
        + f") from infinite), {features_ctes(infinite, source='finite')} select {KEY}, {', '.join(_rounded(n, n) for n in infinite)}, fret12 from f",
        "eda_missing_infinite": f"with {BARS}, {INFINITE} {per_column(MISSING, source='infinite')}",
        # Of tree models, the rows they forecast: the label and that every forecast is in reach of the training labels.
        **{name: f"with {BARS}, {features_ctes(['ob_imb0'])} select {KEY}, fret12, true in_range from f where date between 20240121 and 20240131"
           for name in ("gbt_forecast_rows", "tree_forecast_rows", "tree_baseline_rows")},
        "eda_info": info_sql(),
        "eda_describe": f"with {BARS} {per_column(DESCRIBE)}",
        "eda_histogram": f"with {BARS} {per_column(HISTOGRAM)}",
        "eda_box": f"with {BARS} {per_column(BOX, VALUES)}",
        "eda_missing": f"with {BARS} {per_column(MISSING)}",
        "eda_price_series": f"with {BARS} select {KEY}, midpx, open, high, low, lastpx from bars",
        "eda_volume_series": f"with {BARS} select {KEY}, tradeBuyQty, tradeSellQty from bars",
        "eda_clean_fill": f"with {BARS}, {CLEAN} select {BAR_SELECT.replace('fret12', 'round(fret12, 9) + 0::double fret12')} from k",
        "eda_ffill": f"with {BARS} select {KEY}, {', '.join(f'last_value({c} ignore nulls) over w {c}' for c in VALUES)} from bars"
        " window w as (partition by symbol order by date, \"interval\" rows between unbounded preceding and current row)",
        "eda_bfill": f"with {BARS} select {KEY}, {', '.join(f'first_value({c} ignore nulls) over w {c}' for c in VALUES)} from bars"
        " window w as (partition by symbol order by date, \"interval\" rows between current row and unbounded following)",
        "eda_fill_mean": f"with {BARS} select {KEY}, {', '.join(f'round(coalesce({c}, avg({c}) over ()), 6) + 0::double {c}' for c in VALUES)} from bars",
        "eda_clean_drop": f"with {BARS} select {BAR_SELECT} from bars where not coalesce(\"interval\" % 1000000 between 113000 and 130000, false)"
        f" and {' and '.join(f'{c} is not null' for c in VALUES)}",
        "eda_minmax": f"with {BARS}, {CLEAN}, {MINMAX} select {KEY}, {', '.join(f'round({c}, 9) + 0::double {c}' for c in VALUES)} from mm",
        "eda_pca_two": PCA2 + "select 'midpx' feature, round(x1, 6) + 0::double \"PC1\", round(x2, 6) + 0::double \"PC2\" from o"
        " union all select 'tradeBuyQty', round(y1, 6) + 0::double, round(y2, 6) + 0::double from o",
    }
    pca = f"with {BARS}, {CLEAN}, {MINMAX}, {components_ctes()}"
    sql["eda_pca_loadings"] = pca + ' select feature, round("PC1", 6) + 0::double "PC1", round("PC2", 6) + 0::double "PC2" from pcs'
    sql["eda_pca_scores"] = pca + f""" select symbol, date, "interval", round(sum(x * "PC1"), 6) + 0::double "PC1", round(sum(x * "PC2"), 6) + 0::double "PC2"
from centred join pcs on f = feature join numbered using (rn) group by 1, 2, 3"""
    sql["eda_clean_fill_blocked"] = sql["eda_clean_fill"]
    for name, names in families.items():
        sql[name] = features_sql(names)
    return sql
