"""SQL equivalents of the registered queries, written for DuckDB on the sample tables.

They are formulated on their own (window functions, inequality and ASOF joins, holiday rules in
SQL), not generated from the Spark code, so that an error in one does not hide in the other.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

HORIZONS = {"5d": "5d", "1m": "1m", "3m": "3m", "6m": "6m", "1y": "1y", "ytd": "Ytd", "3y": "3y"}
PERF = [f"perf{v}" for v in HORIZONS.values()]
REF = [f"ref{v}" for v in HORIZONS.values()]


def r4(x: str) -> str:
    """Round half up on the printed number, exactly as a decimal."""
    return f"cast(round(cast(cast(({x}) as varchar) as decimal(38,18)), 4) as double)"


def pct(p: str, b: str) -> str:
    return r4(f"(({p}) - ({b})) / nullif({b}, 0) * 100")


def dec6(x: str) -> str:
    return f"cast(cast(({x}) as varchar) as decimal(28,6))"


def sql(final: str, *ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final


# --- building blocks --------------------------------------------------------------------------

NY = "at time zone 'UTC' at time zone 'America/New_York'"
EVENTS = """ev as (
  select event_id, ts, user_id, event_type, value, cast(props->>'k' as bigint) as k from events)"""
TICKER = {
    "narrow": "upper(event_type)",
    "wide": "'U' || user_id",
    "brand": "'Brand#' || (k % 30 + 1)",
}


def minute(kind: str) -> str:
    return f"""{EVENTS},
keyed as (select {TICKER[kind]} as ticker, epoch_us(ts) // 60000000 as m, ts, event_id, value, k from ev),
ordered as (select *, row_number() over (partition by ticker, m order by ts, event_id) as a,
  row_number() over (partition by ticker, m order by ts desc, event_id desc) as z from keyed),
mb as (select ticker, m * 60000000000 as window_start, cast(sum(k) as double) as volume,
  max(case when a = 1 then value end) as open, max(case when z = 1 then value end) as close,
  max(value) as high, min(value) as low, count(*) as transactions from ordered group by ticker, m),
ny as (select *, make_timestamp(window_start // 1000) {NY} as ts_ny from mb),
silver as (select *, strftime(ts_ny, '%Y-%m-%d') as date, case
  when cast(ts_ny as time) >= time '04:00' and cast(ts_ny as time) < time '09:30' then 'pre_market'
  when cast(ts_ny as time) >= time '09:30' and cast(ts_ny as time) < time '16:00' then 'market'
  when cast(ts_ny as time) >= time '16:00' and cast(ts_ny as time) < time '20:00' then 'post_market'
  else 'closed' end as session from ny)"""


def rolled(source: str, keys: str, where: str = "true") -> str:
    return f"""select {keys}, first(open order by window_start) as open, max(high) as high,
  min(low) as low, last(close order by window_start) as close, sum(volume) as volume,
  cast(sum(transactions) as bigint) as transactions, min(window_start) // 1000000 as timestamp_ms
from {source} where {where} group by all"""


LINES = """lines as (
  select p_brand as ticker, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as price,
    cast(l_quantity as bigint) as shares, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from lineitem join part on l_partkey = p_partkey)"""
HISTORY = f"""{LINES},
ranked as (select *,
  row_number() over (partition by ticker, date
    order by l_orderkey, l_linenumber, l_partkey, l_suppkey, price) as a,
  row_number() over (partition by ticker, date
    order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, price desc) as z
  from lines),
bars as (select ticker, date, max(case when a = 1 then price end) as open, max(price) as high,
  min(price) as low, max(case when z = 1 then price end) as close,
  cast(sum(shares) as bigint) as volume, count(*) as transactions,
  epoch_ms(cast(date as timestamp)) as timestamp_ms from ranked group by ticker, date)"""

GOOD_FRIDAYS = """'1991-03-29', '1992-04-17', '1993-04-09', '1994-04-01', '1995-04-14', '1996-04-05',
    '1997-03-28', '1998-04-10', '1999-04-02', '2000-04-21', '2001-04-13', '2002-03-29', '2020-04-10',
    '2021-04-02', '2022-04-15', '2023-04-07', '2024-03-29'"""
SPECIAL = """'1994-04-27', '2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14', '2004-06-11',
    '2007-01-02', '2012-10-29', '2012-10-30', '2018-12-05'"""


def calendar(first: int, last: int) -> str:
    return f"""wd as (select cast(d as date) as day, year(d) as y, month(d) as m, day(d) as dd, isodow(d) as w
  from generate_series(timestamp '{first}-01-01', timestamp '{last}-12-31', interval 1 day) t(d)),
td as (select day, case when (m = 11 and w = 5 and dd between 23 and 29)
    or (m = 12 and dd = 24 and w <= 4)
    or (m = 7 and dd = 3 and y >= 1995 and (w in (1, 2, 4) or (w = 3 and y >= 2013)))
    or (m = 7 and dd = 5 and w = 5 and y between 1996 and 2012) then 780 else 960 end as close_minute
  from wd where w <= 5 and not (
    (m = 1 and (dd = 1 or (dd = 2 and w = 1)))
    or (y >= 1998 and m = 1 and w = 1 and dd between 15 and 21)
    or (m = 2 and w = 1 and dd between 15 and 21)
    or strftime(day, '%Y-%m-%d') in ({GOOD_FRIDAYS})
    or (m = 5 and w = 1 and dd >= 25)
    or (y >= 2022 and m = 6 and (dd = 19 or (dd = 18 and w = 5) or (dd = 20 and w = 1)))
    or (m = 7 and (dd = 4 or (dd = 3 and w = 5) or (dd = 5 and w = 1)))
    or (m = 9 and w = 1 and dd <= 7)
    or (m = 11 and w = 4 and dd between 22 and 28)
    or (m = 12 and (dd = 25 or (dd = 24 and w = 5) or (dd = 26 and w = 1)))
    or strftime(day, '%Y-%m-%d') in ({SPECIAL})))"""


OLD = calendar(1991, 2002)
NEW = calendar(2020, 2024)

ALL_DATES = "asofs as (select distinct cast(l_shipdate as date) as as_of from lineitem)"
LAST_DATE = "asofs as (select cast(max(l_shipdate) as date) as as_of from lineitem)"
REFDATES = """b1 as (select as_of, max(day) as last from asofs join td on day <= as_of group by as_of),
b2 as (select as_of, last, max(day) as prev from b1 join td on day < last group by as_of, last),
targets as (
  select as_of, 'prev' as label, prev as target from b2
  union all select as_of, '5d', last - 5 from b2
  union all select as_of, '1m', cast(last - interval 1 month as date) from b2
  union all select as_of, '3m', cast(last - interval 3 month as date) from b2
  union all select as_of, '6m', cast(last - interval 6 month as date) from b2
  union all select as_of, '1y', cast(last - interval 1 year as date) from b2
  union all select as_of, '3y', cast(last - interval 3 year as date) from b2
  union all select as_of, 'ytd', make_date(year(as_of) - 1, 12, 31) from b2),
refdates as (select as_of, label, day as ref_date from targets asof join td on target >= day
  where day >= as_of - 1200)"""


def labelled(prefix: str, value: str) -> str:
    names = {"prev": "prevClose", **{k: f"{prefix}{v}" for k, v in HORIZONS.items()}}
    return ", ".join(f"max({value}) filter (label = '{k}') as {n}" for k, n in names.items())


REFCLOSES = f"""refcloses as (select as_of, ticker, {labelled("ref", "close")}
  from bars join refdates on date = ref_date group by as_of, ticker)"""


def newest(days: int) -> str:
    return f"""back as (select as_of, cast(as_of as date) - cast(k as integer) as date from asofs, range({days + 1}) t(k)),
recent as materialized (select as_of, ticker, close, volume, timestamp_ms,
    row_number() over (partition by as_of, ticker order by date desc) as rn
  from bars join back using (date)),
top as (select as_of, ticker, close as price, volume, timestamp_ms as "timestamp" from recent where rn = 1),
second as (select as_of, ticker, nullif(close, 0) as second_close from recent where rn = 2)"""


def close_rows(days: int, name: str = "closes") -> str:
    perf = ", ".join(f"{pct('price', r)} as {p}" for r, p in zip(REF, PERF, strict=True))
    return f"""{newest(days)},
{name} as (select as_of, ticker, price, {r4("price - prevClose")} as change,
  {pct("price", "prevClose")} as changePct, volume, "timestamp", prevClose, {perf}, {", ".join(REF)}
  from top full outer join refcloses using (as_of, ticker))"""


POSITIONS = f"""{LINES},
pos as (select o_orderkey as id, o_custkey as user_id, ticker, cast(shares as double) as shares,
    cast({dec6("price")} as double) as cost_basis, o_orderdate as opened_at
  from lines join orders on l_orderkey = o_orderkey)"""
WATCH = """watch as (select o_custkey as user_id, ticker, min(l_linenumber) as sort_order
  from lines join orders on l_orderkey = o_orderkey group by all)"""
QUOTES = f"""{OLD}, {LAST_DATE}, {REFDATES}, {REFCLOSES}, {close_rows(10)},
quotes as (select * exclude (as_of) from closes)"""
REPORT = """report as (select c_name as username, pos.id, pos.ticker, shares, cost_basis, opened_at, price,
    shares * cost_basis as totalCost, shares * price as marketValue,
    shares * price - shares * cost_basis as pl,
    (shares * price - shares * cost_basis) / nullif(shares * cost_basis, 0) * 100 as plPct,
    shares * change as dayPl, changePct as dayPlPct
  from pos join customer on c_custkey = user_id left join quotes using (ticker))"""


def ticks(kind: str) -> str:
    return f"""{EVENTS},
msg as (select {TICKER[kind]} as ticker, value as price, event_id as seq, k as volume,
    epoch_us(ts) // 1000 as "timestamp",
    coalesce(
      nullif(case event_type when 'view' then 0.0 when 'click' then cast(k as double)
        when 'purchase' then cast(k as double) end, 0),
      nullif(case when event_type <> 'error' then value / 2 end, 0), value) as open from ev),
ticks as (select ticker, price, open, price - open as change,
  coalesce((price - open) / nullif(open, 0) * 100, 0) as changePct, "timestamp", volume,
  'spark' as node, seq from msg)"""


ENRICHED = f"""enriched as (select t.ticker, t.price, t.open,
    case when q.prevClose is not null then {r4("t.price - q.prevClose")} else t.change end as change,
    case when q.prevClose is not null then {pct("t.price", "q.prevClose")} else t.changePct end as changePct,
    t."timestamp", t.volume, t.node, t.seq, q.prevClose,
    {", ".join(f"{pct('t.price', 'q.' + r)} as {p}" for r, p in zip(REF, PERF, strict=True))}
  from ticks t left join quotes q on t.ticker = q.ticker)"""
NEWEST_TICK = """newest as (select * from (
  select *, row_number() over (partition by ticker order by "timestamp" desc, seq desc) as rn from {0})
  where rn = 1)"""

# --- bars -------------------------------------------------------------------------------------

ORACLE["session_volume"] = sql(
    "select session, count(*) as bars, sum(volume) as volume, "
    "cast(sum(transactions) as bigint) as transactions from silver group by session",
    minute("narrow"),
)
ORACLE["event_sessions"] = f"""
with t as (select event_type, hour(ts {NY}) * 60 + minute(ts {NY}) as m from events)
select event_type, case when m between 240 and 569 then 'pre_market' when m between 570 and 959 then 'market'
  when m between 960 and 1199 then 'post_market' else 'closed' end as session, count(*) as n
from t group by all"""
ORACLE["minute_bars"] = sql(
    "select ticker, window_start, volume, open, close, high, low, transactions, date from silver",
    minute("narrow"),
)
ORACLE["silver_bars"] = sql(
    'select ticker, date, window_start, ts_ny as "timestamp", session, close from silver', minute("wide")
)
ORACLE["daily_bars"] = sql(rolled("silver", "ticker, date", "session = 'market'"), minute("wide"))
ORACLE["history_bars"] = sql("select * from bars", HISTORY)
ORACLE["hourly_bars"] = sql(
    rolled("silver", "ticker, time_bucket(interval 2 hour, ts_ny, timestamp '2000-01-01') as bucket"),
    minute("narrow"),
)
ORACLE["monthly_bars"] = sql(
    rolled("b", "ticker, cast(date_trunc('month', date) as timestamp) as bucket").replace(
        "sum(volume) as volume", "cast(sum(volume) as bigint) as volume"
    ),
    HISTORY,
    "b as (select *, timestamp_ms * 1000000 as window_start from bars)",
)
ORACLE["latest_bar"] = sql(
    """select ticker, close as price, cast(volume as bigint) as volume, timestamp_ms as "timestamp"
from daily where date between (select cast(cast(max(date) as date) - 5 as varchar) from daily) and (select max(date) from daily)
qualify row_number() over (partition by ticker order by date desc) = 1""",
    minute("wide"),
    f"daily as ({rolled('silver', 'ticker, date')})",
)
ORACLE["prev_close_by_bar"] = sql(
    """select ticker, date, close,
  lag(close) over (partition by ticker order by date) as prev_close from bars""",
    HISTORY,
)
ORACLE["last_bars"] = sql(
    """select ticker, date, close, cast(row_number() over (partition by ticker order by date desc) as integer) as rank
from bars qualify rank <= 3""",
    HISTORY,
)

# --- calendar ---------------------------------------------------------------------------------

ORACLE["trading_dates"] = sql(
    "select as_of, "
    + ", ".join(
        f"max(ref_date) filter (label = '{k}') as d_{k}" for k in ["prev", *HORIZONS]
    )
    + " from refdates group by as_of",
    OLD,
    ALL_DATES,
    REFDATES,
)
ORACLE["next_trading_day"] = sql(
    """select as_of as day, coalesce(min(td.day) filter (td.day <= as_of + 10), as_of) as next_trading_day
from asofs left join td on td.day >= as_of group by as_of""",
    OLD,
    ALL_DATES,
)
ORACLE["last_trading_day"] = sql(
    """select td.day as last_trading_day, count(*) as lines
from (select cast(l_shipdate as date) as d from lineitem) asof left join td on d >= td.day group by all""",
    OLD,
)
ORACLE["trading_day_flag"] = sql(
    f"select event_id, cast(ts {NY} as date) in (select day from td) as is_trading_day from events", NEW
)


def status(source: str, key: str, cal: str) -> str:
    return sql(
        f"""select {key}, session, is_holiday, case when is_holiday then 'Market Holiday' end as holiday_name,
  cast(epoch((cast(open_day as timestamp) + interval 4 hour) at time zone 'America/New_York') as bigint) as next_open,
  cast(epoch((cast(close_day as timestamp) + to_minutes(
    case when coalesce(ct.close_minute, 960) < 960 then ct.close_minute + 180 else 1200 end))
    at time zone 'America/New_York') as bigint) as next_close
from (select *, case when m < 240 and close_minute is not null then d else nxt end as open_day,
    case when session <> 'closed' or (m < 240 and close_minute is not null) then d else nxt end as close_day
  from (select *, close_minute is null and isodow(d) <= 5 as is_holiday,
      case when close_minute is null or m < 240 then 'closed'
        when m < 570 then 'pre-market'
        when m < 960 then case when close_minute < 960 and m >= close_minute then 'post-market' else 'open' end
        when m < case when close_minute < 960 then close_minute + 180 else 1200 end then 'post-market'
        else 'closed' end as session
    from local left join td on td.day = d left join following using (d)))
  left join td ct on ct.day = close_day""",
        cal,
        f"local as (select {key}, cast(w as date) as d, hour(w) * 60 + minute(w) as m from ({source}))",
        """following as (select d, coalesce(min(day) filter (day <= d + 11), d + 1) as nxt
  from (select distinct d from local) left join td on day > d group by d)""",
    )


ORACLE["market_status"] = status(f"select event_id, ts {NY} as w from events", "event_id", NEW)
ORACLE["market_status_history"] = status(
    f"""select o_orderkey, (o_orderdate + to_minutes(cast(trunc(o_totalprice) as bigint) % 96 * 15)) {NY} as w
  from orders""",
    "o_orderkey",
    OLD,
)

# --- performance ------------------------------------------------------------------------------

ORACLE["reference_closes"] = sql(
    "select * from refcloses", HISTORY, OLD, ALL_DATES, REFDATES, REFCLOSES
)
ORACLE["performance"] = sql(
    "select * from closes", HISTORY, OLD, ALL_DATES, REFDATES, REFCLOSES, close_rows(5)
)
ORACLE["close_of_day_cache"] = sql(
    "select * exclude (as_of) from closes", HISTORY, OLD, LAST_DATE, REFDATES, REFCLOSES, close_rows(5)
)
ORACLE["seed_cache"] = sql(
    f"""select as_of, ticker, price, {r4("price - second_close")} as change,
  {pct("price", "second_close")} as changePct, volume, "timestamp", second_close as prevClose,
  {", ".join(PERF + REF)} from closes left join second using (as_of, ticker) where price is not null""",
    HISTORY,
    OLD,
    ALL_DATES,
    REFDATES,
    REFCLOSES,
    close_rows(10),
)

# --- universe and portfolio -------------------------------------------------------------------

ORACLE["tracked_universe"] = sql(
    "select 'Brand#' || (k % 30 + 1) as ticker from ev union select ticker from pos order by ticker",
    EVENTS,
    POSITIONS,
)
ORACLE["universe_diff"] = """
with cur as (select 'U' || o_custkey as ticker from orders union select p_brand from part),
new as (select 'U' || user_id as ticker from events
  union select 'Brand#' || (cast(props->>'k' as bigint) % 30 + 1) from events)
select ticker, 'add' as action from (select ticker from new except select ticker from cur)
union all select ticker, 'remove' from (select ticker from cur except select ticker from new)"""
WATCH_REPORT = f"""wr as (select c_name as username, watch.ticker, sort_order, price, change, changePct, volume,
  prevClose, {", ".join(PERF)}
  from watch join customer on c_custkey = user_id left join quotes using (ticker))"""
ORACLE["watchlist_report"] = sql(
    "select ticker, username, sort_order, price, change, changePct, volume, prevClose, "
    + ", ".join(PERF)
    + " from wr",
    HISTORY,
    WATCH,
    QUOTES,
    WATCH_REPORT,
)
ORACLE["watchlist_order"] = sql(
    """select c_name as username, ticker, sort_order, rank() over (partition by c_name order by sort_order, ticker) as rank
from watch join customer on c_custkey = user_id""",
    LINES,
    WATCH,
)
ORACLE["watchlist_sorted"] = sql(
    """select username, ticker, perf1m, rank() over (partition by username order by perf1m desc nulls last, ticker) as rank
from wr""",
    HISTORY,
    WATCH,
    QUOTES,
    WATCH_REPORT,
)
BOOK = POSITIONS.replace(LINES + ",\n", "")
ORACLE["positions_report"] = sql(
    "select *, rank() over (partition by username order by opened_at, id) as rank from report", HISTORY, BOOK, QUOTES, REPORT
)
ORACLE["portfolio_totals"] = sql(
    """select *, case when grandCost > 0 then totalPl / grandCost * 100 else 0 end as totalPlPct from t""",
    HISTORY,
    BOOK,
    QUOTES,
    REPORT,
    f"""t as (select username, cast(sum({dec6("coalesce(marketValue, totalCost)")}) as double) as totalValue,
  cast(sum({dec6("coalesce(pl, 0)")}) as double) as totalPl,
  cast(sum({dec6("totalCost")}) as double) as grandCost from report group by username)""",
)

# --- ticks ------------------------------------------------------------------------------------

ORACLE["normalize_ticks"] = sql("select * from ticks", ticks("wide"))
ORACLE["feed_symbols"] = """
with typed as (select event_type as s from events union all select p_brand from part
  union all select 'a.' || p_brand from part),
clean as (select trim(upper(s)) as s from typed)
select case when s like 'A.%' then s else 'A.' || s end as symbol, count(*) as n from clean group by all"""
ORACLE["ticker_validation"] = """
select event_id, upper(trim(event_type)) as ticker,
  regexp_full_match(upper(trim(event_type)), '[A-Z]{1,5}') as valid from events"""
ORACLE["position_inputs"] = sql(
    """select event_id, ticker, shares, total_cost, error,
  case when error is null then total_cost / shares end as cost_basis
from (select event_id, upper(event_type) as ticker, cast(k as double) as shares, value as total_cost,
  case when length(event_type) > 5 then 'invalid ticker' when k <= 0 then 'shares must be > 0'
    when value <= 0 then 'total cost must be > 0' end as error from ev)""",
    EVENTS,
)
ORACLE["enriched_ticks"] = sql("select * from enriched", HISTORY, QUOTES, ticks("brand"), ENRICHED)
ORACLE["latest_tick"] = sql(
    "select * exclude (rn) from newest", ticks("wide"), NEWEST_TICK.format("ticks")
)
ORACLE["cache_merge"] = sql(
    "select coalesce(n.ticker, q.ticker) as ticker, "
    + ", ".join(
        f'coalesce(n."{c}", q."{c}") as "{c}"'
        for c in ["price", "change", "changePct", "volume", "timestamp", *PERF]
    )
    + ", q.prevClose, "
    + ", ".join(f"q.{c}" for c in REF)
    + " from newest n full outer join quotes q on n.ticker = q.ticker",
    HISTORY,
    QUOTES,
    ticks("brand"),
    ENRICHED,
    NEWEST_TICK.format("enriched"),
)
ORACLE["cached_ticks"] = sql(
    """select ticker, price, coalesce(change, 0) as change, coalesce(changePct, 0) as changePct,
  coalesce(volume, 0) as volume, coalesce("timestamp", 0) as "timestamp", prevClose, """
    + ", ".join(PERF)
    + " from quotes where price > 0",
    HISTORY,
    QUOTES,
)
ORACLE["tick_direction"] = sql(
    """select seq, ticker, price, case when price > p then 'up' when price < p then 'down' else 'none' end as direction
from (select *, lag(price) over (partition by ticker order by "timestamp", seq) as p from ticks)""",
    ticks("narrow"),
)
ORACLE["demo_feed"] = sql(
    "select seq, ticker, price from ticks where ticker in (select p_brand from part where p_size = 1)",
    ticks("brand"),
)

# --- change feeds -----------------------------------------------------------------------------

MOVES = f"""{EVENTS},
chg as (select event_id as seq, user_id, case when event_type in ('view', 'click') then 'add'
    when event_type = 'signup' then 'reorder' else 'remove' end as op,
    unnest(range(0, event_id % 4 + 1)) as position, k from ev),
steps as (select seq, user_id, op, position, 'Brand#' || ((k % 25 + position) * 7 % 25 + 1) as ticker from chg)"""
# A row lives from its base entry, or from the first add of a run of adds, until a remove.
LIVES = """base_and_adds as (
  select user_id, ticker, -1 as seq, 'base' as op, 0 as position, sort_order from watch
  union all select user_id, ticker, seq, op, position, null from steps where {0}),
runs as (select *, count(*) filter (op = 'remove') over (partition by user_id, ticker
    order by seq, position rows unbounded preceding) as life,
  count(*) filter (op = 'remove') over (partition by user_id, ticker) as last_life from base_and_adds),
born as (select *, min(seq) filter (op in ('base', 'add')) over (partition by user_id, ticker) as born_at
  from runs where life = last_life and op <> 'remove'),
final as (select user_id, ticker, coalesce(
    last(position order by seq, position) filter (op = 'reorder' and seq > born_at),
    max(sort_order), 0) as sort_order from born where born_at is not null group by user_id, ticker)"""
ORACLE["apply_watchlist_changes"] = sql(
    "select user_id, ticker, cast(sort_order as integer) as sort_order from final",
    LINES,
    WATCH,
    MOVES,
    LIVES.format("true"),
)
ORACLE["reorder_watchlist"] = sql(
    "select user_id, ticker, cast(sort_order as integer) as sort_order from final",
    LINES,
    WATCH,
    MOVES,
    LIVES.format("op = 'reorder'"),
)
ORACLE["apply_position_changes"] = sql(
    """select a.id, a.user_id, a.ticker,
  coalesce((last(e.shares order by e.seq) filter (e.op = 'update')), any_value(a.shares)) as shares,
  coalesce((last(e.basis order by e.seq) filter (e.op = 'update')), any_value(a.cost_basis)) as cost_basis
from alive a left join edits e on e.id = a.id and e.user_id = a.user_id and e.seq > a.born_at
group by all having not coalesce(bool_or(e.op = 'delete'), false)""",
    LINES,
    EVENTS,
    """lots as (select l_orderkey as id, o_custkey as user_id, min(ticker) as ticker,
    cast(sum(shares) as double) as shares,
    cast(cast(cast(cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(shares) as varchar)
      as decimal(18,6)) as double) as cost_basis
  from lines join orders on o_orderkey = l_orderkey group by l_orderkey, o_custkey)""",
    f"""edits as (select event_id as seq, case when event_type = 'view' then e.user_id else o_custkey end as user_id,
    case event_type when 'purchase' then 'add' when 'error' then 'delete' else 'update' end as op,
    case when event_type = 'purchase' then event_id + 1000000000000 else o_orderkey end as id,
    upper(event_type) as ticker, cast(k + 1 as double) as shares, cast({dec6("value")} as double) as basis
  from ev e join orders on o_orderkey = event_id // 2)""",
    """alive as (select *, -1 as born_at from lots
  union all select id, user_id, ticker, shares, basis, seq from edits where op = 'add')""",
)

# --- completeness -----------------------------------------------------------------------------

ORACLE["counts_per_date"] = sql("select date, count(*) as rows from silver group by date", minute("narrow"))
ORACLE["missing_sessions"] = sql(
    """select day as date from td, (select min(d) as lo, max(d) as hi from b)
where day between lo and hi and day not in (select d from b)""",
    OLD,
    """b as (select distinct cast(l_shipdate as date) as d from lineitem)""",
)

# --- lakehouse files and streams --------------------------------------------------------------

ORACLE["csv_to_bronze"] = sql(
    """select ticker, volume, open, close, high, low, window_start, transactions,
  case when cast(date[9:10] as integer) % 3 < 2 then '' end as otc, date
from silver""",
    minute("narrow"),
)
ORACLE["silver_overwrite"] = ORACLE["silver_bars"]
ORACLE["load_report"] = sql(
    """select date, case when dd % 10 = 0 then 'empty' when bool_or(volume = 99 and close > 150) then 'failed' else 'ok' end as status,
  case when dd % 10 = 0 then 0 else count(*) end as rows,
  case when dd % 10 = 0 then 0 else count(*) filter (volume = 99 and close > 150) end as bad_rows, true as named, true as timed
from (select *, cast(date[9:10] as integer) as dd from silver) group by date, dd""",
    minute("wide"),
)
ORACLE["daily_ingest"] = sql(
    """select date, case kind when 0 then 'unreadable' when 1 then case when bad > 0 then 'failed' else 'ok' end when 2 then 'empty' else 'ok' end as status,
  case when kind in (0, 2) then 0 else n end as rows, case when kind = 1 then bad else 0 end as bad_rows,
  case when kind > 2 or (kind = 1 and bad = 0) then n end as bronze_rows, case when kind > 2 or (kind = 1 and bad = 0) then n end as silver_rows
from (select date, cast(date[9:10] as integer) % 7 as kind, count(*) as n, count(*) filter (window_start // 60000000000 % 5 = 0) as bad
  from silver group by date)
union all select null, 'undated', 0, 0, null, null where exists (select 1 from silver where cast(date[9:10] as integer) % 7 = 3)""",
    minute("wide"),
)
ORACLE["commit_retry"] = sql(
    """select ticker, date, window_start, close + case when dd % 10 in (1, 2) then 1000 else 0 end as close,
  case when dd % 10 = 2 then 2 else 1 end as loads
from (select *, cast(date[9:10] as integer) as dd from silver)""",
    minute("narrow"),
)
ORACLE["stream_cache"] = ORACLE["cache_merge"]
ORACLE["stream_deltas"] = sql(
    "select ticker, 'tick' as type, price, change, perf5d from enriched",
    HISTORY,
    QUOTES,
    ticks("brand"),
    ENRICHED,
)

ORACLE["stream_direction"] = ORACLE["tick_direction"]
ORACLE["stream_latest"] = ORACLE["latest_tick"]
ORACLE["stream_demo"] = ORACLE["demo_feed"]
ORACLE["single_file"] = sql(
    """select date, count(*) as bronze, count(*) as silver, case when date = (select max(date) from silver) then cast(1 as bigint) end as loads
from silver group by date""",
    minute("wide"),
)
ORACLE["cache_producers"] = ORACLE["cache_merge"]
MERGED = "merged as (" + ORACLE["cache_merge"][ORACLE["cache_merge"].rindex("\nselect ") :] + ")"
ORACLE["stream_snapshot"] = sql(
    """select c_name as username, ticker, price, coalesce(change, 0) as change, coalesce(changePct, 0) as changePct,
  coalesce(volume, 0) as volume, coalesce("timestamp", 0) as "timestamp", perf5d, perf3y
from watch join customer on c_custkey = user_id join merged using (ticker) where price > 0""",
    HISTORY,
    WATCH,
    QUOTES,
    ticks("brand"),
    ENRICHED,
    NEWEST_TICK.format("enriched"),
    MERGED,
)
ORACLE["dead_letters"] = sql(
    """select case k % 9 when 0 then 'unparsable' when 1 then 'no ticker' else 'no price' end as fault, count(*) as n
from ev where k % 9 < 3 group by all
union all select '(records)', count(*) from ev
union all select '(dead)', count(*) from ev where k % 9 < 3
union all select '(ticks)', count(*) from ev where k % 9 >= 3""",
    EVENTS,
)
ORACLE["stream_watchlists"] = ORACLE["apply_watchlist_changes"]
ORACLE["ticker_gaps"] = sql(
    """select ticker, last_before, first_after, (select count(*) from td where day > last_before and day < first_after) as missing
from (select ticker, lag(date) over (partition by ticker order by date) as last_before, date as first_after
  from bars where date in (select day from td))
where exists (select 1 from td where day > last_before and day < first_after)""",
    HISTORY,
    OLD,
)
