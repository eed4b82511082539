"""Equivalent SQL for the registered queries, written against the given tables and run by another engine.

The texts share building blocks for the derived inputs (the same rows that `suite.tables` derives), while the operator
itself is written out in plain SQL: windows over whole groups, self-joins, recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

from scourframe.functions.hashing import FOLD, MULTIPLIER, SALT_STEP, SPACE
from scourframe.operators import generate as G
from scourframe.operators import grade as Q
from scourframe.operators import inject as I
from suite import tables as T

ORACLES: dict[str, str] = {}
MASK = SPACE - 1
NUM = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
PLAUSIBLE = "(20[0-2][0-9]|2030)"


# -- expressions ------------------------------------------------------------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def h(key: str, salt: int) -> str:
    folded = f"xor((({key})::BIGINT) & {MASK}, ((((({key})::BIGINT) >> 32) & {MASK}) * {FOLD}) & {MASK})"
    a = f"(({folded} * {MULTIPLIER} + {salt * SALT_STEP}) & {MASK})"
    b = f"((xor({a}, ({a} >> 15)) * {MULTIPLIER}) & {MASK})"
    return f"xor({b}, ({b} >> 13))"


def h_int(key: str, salt: int, low: int, high: int) -> str:
    return f"({low} + (({h(key, salt)} * {high - low}) >> 32))"


def h_unit(key: str, salt: int) -> str:
    return f"({h(key, salt)} / {float(SPACE)}::DOUBLE)"


def h_uniform(key: str, salt: int, low: float, high: float) -> str:
    return round2(f"({low}::DOUBLE + {high - low}::DOUBLE * {h_unit(key, salt)})")


def h_choice(key: str, salt: int, values: Sequence[str]) -> str:
    listed = ", ".join(q(v) for v in values)
    return f"([{listed}])[{h_int(key, salt, 1, len(values) + 1)}]"


def h_slice(hashed: str, rate: float, start: float = 0.0) -> str:
    return f"({hashed} >= {int(start * SPACE)} AND {hashed} < {int((start + rate) * SPACE)})"


def h_selected(key: str, salt: int, rate: float, start: float = 0.0) -> str:
    return h_slice(h(key, salt), rate, start)


def h_date(key: str, salt: int, start: str, end: str) -> str:
    return f"(DATE '{start}' + (({h(key, salt)} * date_diff('day', DATE '{start}', DATE '{end}')) >> 32)::INTEGER)"


def rounded(x: str, places: int) -> str:
    scale = f"{10 ** places}::DOUBLE"
    return f"(round_even(({x})::DOUBLE * {scale}, 0) / {scale} + 0.0::DOUBLE)"


def round2(x: str) -> str:
    return rounded(x, 2)


def round4(x: str) -> str:
    return rounded(x, 4)


def fixed(x: str, places: int) -> str:
    return f"format('{{:.{places}f}}', {rounded(x, places)})"


def strip(x: str) -> str:
    return f"trim({x}, E' \\t')"


def num(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({strip(x)}, '{NUM}') AND isfinite(TRY_CAST({strip(x)} AS DOUBLE)) THEN TRY_CAST({strip(x)} AS DOUBLE) END)"


def money(x: str) -> str:
    return f"(({x})::DECIMAL(18,2)::VARCHAR)"


def numeric_text(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '__NAN__' ELSE coalesce({round2(num(x))}::DECIMAL(38,2)::VARCHAR, '__INVALID__') END)"


def date_text(x: str) -> str:
    """For texts that are ISO dates."""
    return f"(CASE WHEN {x} IS NULL THEN '__NAN__' WHEN year(TRY_CAST({x} AS DATE)) BETWEEN 2000 AND 2030 THEN {x} WHEN TRY_CAST({x} AS DATE) IS NOT NULL THEN '__BAD_DATE__' ELSE '__INVALID_DATE__' END)"


def plain_text(x: str) -> str:
    return f"coalesce({strip(x)}, '__NAN__')"


# -- derived inputs ---------------------------------------------------------------------------------------------------

RAW = """raw AS (SELECT o_orderkey AS row_id, o_custkey::VARCHAR AS custkey, o_orderstatus AS orderstatus,
  o_totalprice::DECIMAL(18,2)::VARCHAR AS price, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  o_orderpriority AS priority FROM orders)"""
RAW_COLUMNS = ("custkey", "orderstatus", "price", "order_date", "priority")


def typo(x: str, key: str, salt: int, typos: dict) -> str:
    cases = " ".join(f"WHEN {x} = {q(v)} THEN {h_choice(key, salt, wrong)}" for v, wrong in typos.items())
    return f"(CASE {cases} ELSE {x} END)"


def outlier(key: str, salt: int) -> str:
    high = h_uniform(key, salt + 1, 5000.0, 15000.0)
    low = h_uniform(key, salt + 2, -500.0, -10.0)
    return f"(CASE WHEN {h_unit(key, salt)} < 0.7::DOUBLE THEN {high} ELSE {low} END)::VARCHAR"


def dirty_value(kind: str, x: str, key: str, salt: int, typos: dict) -> str:
    return {
        I.WORD: h_choice(key, salt, I.BAD_WORDS), I.NULL: "NULL::VARCHAR",
        I.FUTURE_DATE: h_choice(key, salt, I.FUTURE_DATES), I.WHITESPACE: f"('  ' || {x} || '  ')",
        I.OUTLIER: outlier(key, salt), I.TYPO: typo(x, key, salt, typos),
    }[kind]


def corrupted(source: str, columns: Sequence[str], errors, typos: dict, out: str, seed: int = T.SEED) -> str:
    """CTEs: `<out>_k` with a kind per cell, `<out>` with the dirty table."""
    hashes, kinds, cells = [], [], []
    for i, c in enumerate(columns):
        mine = [e for e in errors if e.column == c]
        if not mine:
            kinds.append(f"NULL::VARCHAR AS k_{c}")
            cells.append(c)
            continue
        hashes.append(f"{h('row_id', seed + 10 * i)} AS h_{c}")
        start, cases, values = 0.0, [], []
        for e in mine:
            cases.append(f"WHEN {h_slice(f'h_{c}', e.rate, start)} THEN '{e.kind}'")
            values.append(f"WHEN k_{c} = '{e.kind}' THEN {dirty_value(e.kind, c, 'row_id', seed + 10 * i + 1, typos)}")
            start += e.rate
        kinds.append(f"CASE {' '.join(cases)} END AS k_{c}")
        cells.append(f"CASE {' '.join(values)} ELSE {c} END AS {c}")
    return (
        f"{out}_h AS (SELECT *, {', '.join(hashes)} FROM {source}), "
        f"{out}_k AS (SELECT row_id, {', '.join(columns)}, {', '.join(kinds)} FROM {out}_h), "
        f"{out} AS (SELECT row_id, {', '.join(cells)} FROM {out}_k)"
    )


DIRTY = RAW + ", " + corrupted("raw", RAW_COLUMNS, T.ORDER_ERRORS, {}, "dirty")


def truth(source: str, columns: Sequence[str], errors) -> str:
    parts = []
    for c in dict.fromkeys(e.column for e in errors):
        parts.append(
            f"SELECT k.row_id, '{c}' AS \"column\", k_{c} AS kind, d.{c} AS dirty_value, k.{c} AS clean_value "
            f"FROM {source}_k k JOIN {source} d USING (row_id) WHERE k_{c} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


_USUAL = round2("greatest(5.0::DOUBLE, least(800.0::DOUBLE, abs(c_acctbal) / 13.0::DOUBLE))")
_EXTREME = h_selected("c_custkey", T.SEED + 10, T.EXTREME_RATE, 0.5)
ACCOUNTS = f"""accounts AS (SELECT c_custkey AS row_id, c_custkey + 9001 AS tx_id,
  CASE WHEN {_EXTREME} THEN {h_uniform('c_custkey', T.EXTREME_SALT + 1, 900.0, 2000.0)} ELSE {_USUAL} END AS amount,
  c_mktsegment AS segment, {_EXTREME} AS extreme FROM customer),
  accounts_raw AS (SELECT row_id, tx_id::VARCHAR AS tx_id, amount::VARCHAR AS amount, segment FROM accounts)"""
ACCOUNT_COLUMNS = ("tx_id", "amount", "segment")
BAD_ACCOUNTS = ACCOUNTS + ", " + corrupted("accounts_raw", ACCOUNT_COLUMNS, T.ACCOUNT_ERRORS, T.SEGMENT_TYPOS, "bad")

_FACTOR = f"(0.99::DOUBLE + 0.02::DOUBLE * {h_unit('row_id', T.COPY_SEED + 2)})"
_NEAR = h_selected("row_id", T.COPY_SEED + 1, 0.4)
COPIES = f"""base AS (SELECT o_orderkey AS row_id, o_custkey AS custkey, o_orderstatus AS orderstatus,
  {round2('o_totalprice')} AS amount, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS priority FROM orders),
  made AS (SELECT (SELECT max(row_id) + 1 FROM base) + row_id AS row_id, custkey, orderstatus,
    CASE WHEN {_NEAR} THEN {round2('amount * ' + _FACTOR)} ELSE amount END AS amount, order_date, priority,
    row_id AS original_id, {_NEAR} AS near FROM base WHERE {h_selected('row_id', T.COPY_SEED, T.COPY_RATE)}),
  copies AS (SELECT * FROM base UNION ALL SELECT row_id, custkey, orderstatus, amount, order_date, priority FROM made)"""

PADDED = """padded AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 5 = 0 THEN E' \\t' || c_name || '  ' ELSE c_name END AS label,
  c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer)"""

_NAME = f"({h_choice('o_custkey', 31, G.FIRST_NAMES)} || ' ' || {h_choice('o_custkey', 32, G.LAST_NAMES)})"


def email(name: str) -> str:
    code = f"('0x' || substr(md5({name}), 1, 8))::BIGINT"
    domains = ", ".join(q(d) for d in G.EMAIL_DOMAINS)
    return f"(replace(lower({name}), ' ', '.') || '@' || ([{domains}])[({code} % {len(G.EMAIL_DOMAINS)}) + 1])"


MERGED = f"""named AS (SELECT *, {_NAME} AS full_name FROM orders),
  merged AS (SELECT o_orderkey AS record_id, o_custkey AS customer_id, full_name, {email('full_name')} AS email,
    o_totalprice AS amount, {h_choice('o_orderkey', 33, G.MERGE_CURRENCIES)} AS currency, o_orderdate AS day,
    o_orderpriority AS product_name, o_orderstatus AS region, o_orderkey % 3 AS src FROM named)"""

_COMMAND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.COMMAND_OF_EVENT.items()) + " END"
STEPS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  log0 AS (SELECT user_id, event_id, user_id::VARCHAR AS episode_id, (['easy','medium','hard'])[(user_id % 3) + 1] AS task_id,
    (rn - 1)::INTEGER AS step, CASE WHEN rn > 1 THEN {_COMMAND} END AS command,
    {round4('least(1.0::DOUBLE, 0.012::DOUBLE * (rn - 1) + value / 2000.0::DOUBLE)')} AS score,
    user_id % 40 + 10 AS initial_dirty, {h_selected('event_id', 51, 0.2)} AS picked FROM numbered),
  log AS (SELECT *, coalesce(command = 'DROP_ROW', false) AND task_id = 'medium' AND picked AS dropped_protected,
    CASE task_id WHEN 'easy' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.85::DOUBLE ELSE 0.80::DOUBLE END AS threshold,
    CASE task_id WHEN 'easy' THEN 40 WHEN 'medium' THEN 80 ELSE 150 END AS max_steps,
    CASE task_id WHEN 'easy' THEN 25 WHEN 'medium' THEN 50 ELSE 80 END AS runner_steps FROM log0),
  prev AS (SELECT *, lag(score) OVER (PARTITION BY episode_id ORDER BY step) AS prev_score FROM log),
  cur AS (SELECT *, CASE WHEN command = 'DONE' THEN prev_score ELSE score END AS after FROM prev),
  rewarded AS (SELECT *, CASE WHEN prev_score IS NULL THEN NULL WHEN command = 'DONE' AND prev_score < threshold THEN -1.0::DOUBLE
    ELSE {round4('''greatest(-0.5::DOUBLE, least(1.0::DOUBLE, (after - prev_score)
      + CASE WHEN prev_score < threshold AND after >= threshold THEN 0.10::DOUBLE * (1.0::DOUBLE - step / max_steps::DOUBLE) ELSE 0.0::DOUBLE END
      + CASE WHEN dropped_protected THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN command = 'DONE' AND prev_score < 0.6::DOUBLE THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END + -0.005::DOUBLE))''')} END AS reward,
    coalesce(prev_score IS NOT NULL AND CASE WHEN command = 'DONE' THEN prev_score >= threshold
      ELSE score >= threshold OR step >= max_steps END, false) AS done FROM cur),
  ended AS (SELECT *, min(CASE WHEN done THEN step END) OVER (PARTITION BY episode_id) AS end_step FROM rewarded),
  cut AS (SELECT * FROM ended WHERE end_step IS NULL OR step <= end_step)"""

ACTIONS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  log AS (SELECT user_id::VARCHAR AS episode_id, rn::INTEGER AS step,
    CASE WHEN {h_selected('event_id', 60, 0.02)} THEN 'SKIP' ELSE {_COMMAND} END AS command,
    CASE WHEN NOT {h_selected('event_id', 61, 0.1)} THEN {h_int('event_id', 62, -2, 70)} END AS row_index,
    CASE WHEN NOT {h_selected('event_id', 63, 0.1)} THEN {h_choice('event_id', 64, ('price', 'quantity', 'order_date', ''))} END AS "column",
    CASE WHEN NOT {h_selected('event_id', 65, 0.1)} THEN {money('value')} END AS value,
    CASE WHEN NOT {h_selected('event_id', 66, 0.1)} THEN {h_choice('event_id', 67, ('mean', 'median', 'mode', 'drop', 'Mean'))} END AS fill_strategy
    FROM numbered)"""
_ROW = h_int('event_id', 62, -2, 70)
SCALED = ACTIONS.replace(_ROW, f"CASE WHEN {_ROW} < 0 THEN {_ROW} ELSE trunc({_ROW} * (SELECT count(*) FROM supplier) / 66.0::DOUBLE)::BIGINT END")


def oracle(name: str, ctes: str, select: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}" if ctes else select


# -- profile and rules ------------------------------------------------------------------------------------------------

def _issue(*pairs: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {n} > 0 THEN {n} || '_{label}' END" for n, label in pairs)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',')"


def _status(source: str, column: str, kind: str) -> str:
    missing = f"count(*) FILTER ({column} IS NULL)"
    if kind == "date":
        counts = [
            (f"count(*) FILTER (NOT regexp_full_match({strip(column)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))", "bad_date_format"),
            (f"count(*) FILTER (TRY_CAST(substr({strip(column)}, 1, 4) AS BIGINT) > 2030)", "future_year"),
        ]
    elif kind == "numeric":
        counts = [(f"count(*) FILTER ({column} IS NOT NULL AND {num(column)} IS NULL)", "non_numeric_text")]
    else:
        counts = [(f"count(*) FILTER ({column} <> {strip(column)})", "has_whitespace")]
    counts = [(missing, "missing"), *counts]
    any_issue = " + ".join(f"({c})" for c, _ in counts)
    return (
        f"SELECT '{column}' AS \"column\", {missing} AS missing, ({any_issue}) = 0 AS standardized, "
        f"{_issue(*counts)} AS issues FROM {source}"
    )


def _status_all(source: str, kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(_status(source, c, k) for c, k in kinds.items())


ORDER_KINDS = {"custkey": "numeric", "orderstatus": "string", "price": "numeric", "order_date": "date", "priority": "string"}
PADDED_KINDS = {"label": "string", "segment": "string", "nation": "numeric"}
oracle("profile_orders_dirty", DIRTY, _status_all("dirty", ORDER_KINDS))
oracle("broken_columns", PADDED, f"SELECT * FROM ({_status_all('padded', PADDED_KINDS)}) WHERE missing > 0 OR NOT standardized")
oracle(
    "all_clean",
    PADDED + f", tidy AS (SELECT row_id, {strip('label')} AS label, segment, nation FROM padded)",
    " UNION ALL ".join(
        f"SELECT count(*) FILTER (missing > 0 OR NOT standardized) = 0 AS all_clean, count(*) FILTER (missing > 0 OR NOT standardized) AS broken, "
        f"'{stage}' AS stage FROM ({_status_all(source, PADDED_KINDS)})"
        for stage, source in (("raw", "padded"), ("clean", "tidy"))
    ),
)
oracle("parse_ratio", DIRTY, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS present, count({num(c)}) AS numeric, "
    f"{round4(f'count({num(c)}) / greatest(count({c}), 1)::DOUBLE')} AS ratio, coalesce(bool_and({num(c)} % 1 = 0), true) AS all_whole FROM dirty"
    for c in ("custkey", "price", "priority")
))
oracle("column_centers", DIRTY, f"""SELECT {round2(f"avg({num('price')})")} AS mean, count({num('price')}) AS numeric,
  {round2(f"quantile_cont({num('price')}, 0.5)")} AS median,
  (SELECT custkey FROM dirty WHERE custkey IS NOT NULL GROUP BY custkey ORDER BY count(*) DESC, custkey LIMIT 1) AS mode FROM dirty""")
_VALID = f"regexp_full_match({strip('order_date')}, '{PLAUSIBLE}-[0-9]{{2}}-[0-9]{{2}}')"
oracle("valid_fraction", DIRTY, f"""SELECT count(order_date) AS n_total, count(*) FILTER ({_VALID}) AS n_valid,
  {round4(f"count(*) FILTER ({_VALID}) / count(order_date)::DOUBLE")} AS valid_ratio FROM dirty""")
oracle("filter_suspect", DIRTY, "SELECT row_id, price FROM dirty WHERE price IS NULL OR regexp_matches(price, '[a-zA-Z]')")
_BAD_PRICE = f"(price IS NOT NULL AND ({num('price')} IS NULL OR {num('price')} < 2000 OR {num('price')} > 400000))"
oracle("validate_rules", DIRTY + ", " + COPIES, f"""
  SELECT 'not_null' AS "rule", 'orderstatus' AS "column", count(*) FILTER (orderstatus IS NULL) AS violations FROM dirty
  UNION ALL SELECT 'in_domain', 'orderstatus', count(*) FILTER (orderstatus NOT IN ('O', 'F', 'P')) FROM dirty
  UNION ALL SELECT 'range', 'custkey', count(*) FILTER (custkey IS NOT NULL AND ({num('custkey')} IS NULL OR {num('custkey')} NOT BETWEEN 0 AND 1000)) FROM dirty
  UNION ALL SELECT 'range', 'price', count(*) FILTER {_BAD_PRICE} FROM dirty
  UNION ALL SELECT 'date', 'order_date', count(*) FILTER (order_date IS NOT NULL AND substr(order_date, 1, 4) NOT IN ('1996', '1997', '1998')) FROM dirty
  UNION ALL SELECT 'trimmed', 'priority', count(*) FILTER (priority <> {strip('priority')}) FROM dirty
  UNION ALL SELECT 'scale', 'price', count(*) FILTER ({num('price')}::DECIMAL(18,2) <> round({num('price')}::DECIMAL(18,2), 1)) FROM dirty
  UNION ALL SELECT 'unique', 'custkey', count(custkey) - count(DISTINCT custkey) FROM dirty
  UNION ALL SELECT 'unique', 'amount', count(amount) - count(DISTINCT amount) FROM copies""")
oracle("violating_rows", DIRTY, f"SELECT row_id, price FROM dirty WHERE {_BAD_PRICE}")
oracle("violating_unique", DIRTY, "SELECT row_id, custkey FROM dirty WHERE custkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY row_id) > 1")

# -- scalar functions -------------------------------------------------------------------------------------------------

_COMMA = "(substr(price, 1, 2) || ',' || substr(price, 3, 20))"
oracle("scalar_functions", DIRTY, f"""SELECT row_id, {strip('priority')} AS stripped, lower(priority) AS lowered,
  CASE WHEN length(row_id::VARCHAR) >= 9 THEN row_id::VARCHAR ELSE lpad(row_id::VARCHAR, 9, '0') END AS padded,
  {num('price')} AS number, {num(f"replace({_COMMA}, ',', '')")} AS number_with_comma, {numeric_text('price')} AS number_text,
  {date_text('order_date')} AS date_text, TRY_CAST(substr(order_date, 1, 4) AS BIGINT) AS year, coalesce({_VALID}, false) AS plausible_iso,
  CASE WHEN regexp_full_match({strip('custkey')}, '[+-]?[0-9]+') THEN TRY_CAST(custkey AS BIGINT) END AS whole,
  CASE WHEN {num('price')} IS NOT NULL THEN greatest(2000.0::DOUBLE, least(400000.0::DOUBLE, {num('price')})) END AS clipped,
  CASE {strip('orderstatus')} WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status_name,
  date_diff('day', DATE '1995-01-01', TRY_CAST(order_date AS DATE))::INTEGER AS days,
  strftime(TRY_CAST(order_date AS DATE) + 30, '%Y-%m-%d') AS later, custkey IS NULL AS no_customer FROM dirty""")

_M, _D, _Y = "month(d)", "day(d)", "year(d)"
_SWAPPED = "strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d')"
_FORMS = [
    "strftime(d, '%Y-%m-%d')", f"{_M} || '/' || {_D} || '/' || {_Y}", "strftime(d, '%d.%m.%Y')", "strftime(d, '%d/%m/%Y')",
    f"{_Y} || '/' || {_M} || '/' || {_D}", "strftime(d, '%Y%m%d')", f"strftime(d, '%b ') || {_D} || ' ' || {_Y}",
    f"strftime(d, '%B ') || {_D} || ', ' || {_Y}", f"{_D} || strftime(d, ' %b ') || {_Y}", "strftime(d, '%d-%b-%Y')",
    "strftime(d, '%Y-%m-%d 00:00:00')", "strftime(d, '%m-%d-%Y')",
]
# What each form must give: the date itself where the form says which part is the month or the day is above 12; for
# day-first slashes and dots the parts swap when both could be a month. A guess counts only from the year 2000 on.
_ISO = "strftime(d, '%Y-%m-%d')"
_GUESS = f"CASE WHEN year(d) BETWEEN 2000 AND 2030 THEN {_ISO} ELSE raw END"
_DAY_FIRST = f"CASE WHEN day(d) <= 12 THEN {_SWAPPED} ELSE {_ISO} END"
_NORMALISED = {3: _DAY_FIRST, **{i: _GUESS for i in range(5, 12)}}
_COMPARED = {2: _DAY_FIRST, 3: _DAY_FIRST}
oracle(
    "date_forms",
    "o AS (SELECT o_orderkey AS row_id, o_orderdate::DATE AS d, CASE o_orderkey % 12 "
    + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS))
    + " END AS raw FROM orders)",
    "SELECT row_id, raw, CASE row_id % 12 " + " ".join(f"WHEN {i} THEN {_NORMALISED.get(i, _ISO)}" for i in range(12))
    + " END AS normalised, CASE WHEN year(d) NOT BETWEEN 2000 AND 2030 THEN '__BAD_DATE__' ELSE CASE row_id % 12 "
    + " ".join(f"WHEN {i} THEN {_COMPARED.get(i, _ISO)}" for i in range(12)) + " END END AS compared FROM o",
)

# -- injection and generation -----------------------------------------------------------------------------------------

oracle("inject_errors", DIRTY, truth("dirty", RAW_COLUMNS, T.ORDER_ERRORS))
oracle("inject_outliers_typos", BAD_ACCOUNTS, truth("bad", ACCOUNT_COLUMNS, T.ACCOUNT_ERRORS))


def _picked(name: str, columns: Sequence[str], k: int, seed: int, kind: str, taken: Sequence[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS col, {c} AS v, {h(f'row_id * {len(columns)} + {i}', seed)} AS pick FROM raw" for i, c in enumerate(columns)
    )
    free = "".join(f" AND NOT EXISTS (SELECT 1 FROM {t} WHERE {t}.row_id = c.row_id AND {t}.col = c.col)" for t in taken)
    return (
        f"{name} AS (SELECT row_id, col, '{kind}' AS kind, {dirty_value(kind, 'v', 'pick', seed, {})} AS dirty_value, v AS clean_value "
        f"FROM (SELECT * FROM ({cells}) c WHERE v IS NOT NULL{free} ORDER BY pick, row_id, col LIMIT {k}))"
    )


_PICKS = [
    ("p0", ("custkey", "price"), 100, 300, I.WORD), ("p1", ("price", "orderstatus"), 80, 301, I.NULL),
    ("p2", ("order_date",), 50, 302, I.FUTURE_DATE), ("p3", ("orderstatus", "priority"), 60, 303, I.WHITESPACE),
]
oracle(
    "inject_counts",
    RAW + ", " + ", ".join(_picked(*p, taken=[x[0] for x in _PICKS[:i]]) for i, p in enumerate(_PICKS)),
    " UNION ALL ".join(f'SELECT row_id, col AS "column", kind, dirty_value, clean_value FROM {p[0]}' for p in _PICKS),
)
oracle("plant_valid_extremes", ACCOUNTS, f"""SELECT row_id, {h_uniform('row_id', 79, 900.0, 2000.0)} AS amount
  FROM (SELECT * FROM accounts ORDER BY {h('row_id', 78)}, row_id LIMIT 40)""")
oracle("inject_copies", COPIES, "SELECT original_id, row_id AS duplicate_id, near FROM made")
_F910 = f"(0.99::DOUBLE + 0.02::DOUBLE * {h_unit('o_orderkey', 912)})"
oracle("inject_duplicates", "", f"""SELECT o_orderkey AS original_id, o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders) AS duplicate_id,
  {h_selected('o_orderkey', 911, 0.4)} AS near, CASE WHEN {h_selected('o_orderkey', 911, 0.4)}
    THEN {round2(round2('o_totalprice') + ' * ' + _F910)} ELSE {round2('o_totalprice')} END AS amount
  FROM (SELECT * FROM orders ORDER BY {h('o_orderkey', 910)}, o_orderkey LIMIT 30)""")
oracle("sample_rows", RAW, f"SELECT row_id, price FROM raw ORDER BY {h('row_id', 80)}, row_id LIMIT 300 OFFSET 200")
oracle("shuffle_rows", RAW, f"SELECT row_number() OVER (ORDER BY {h('row_id', 81)}, row_id) - 1 AS row_id, row_id AS old_id FROM raw")

_K = "o_orderkey"
oracle("generate_orders", "", f"""SELECT {_K} AS row_id, {_K} + 1001 AS order_id, 'Customer_' || lpad({h_int(_K, 42, 1, 31)}::VARCHAR, 3, '0') AS customer,
  {h_choice(_K, 43, G.ORDER_PRODUCTS)} AS product, {h_choice(_K, 44, G.ORDER_CATEGORIES)} AS category,
  {h_uniform(_K, 45, 5.0, 500.0)} AS price, {h_int(_K, 46, 1, 20)} AS quantity,
  strftime({h_date(_K, 47, '2023-01-01', '2024-06-30')}, '%Y-%m-%d') AS order_date, {h_choice(_K, 48, G.ORDER_REGIONS)} AS region FROM orders""")
_NORMAL = (
    f"(150.0::DOUBLE + 60.0::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {h_unit(_K, 138)})) * cos(6.283185307179586::DOUBLE * {h_unit(_K, 139)}))"
)
oracle("generate_transactions", "", f"""SELECT {_K} AS row_id, {_K} + 9001 AS tx_id, {h_int(_K, 137, 1, 501)} AS customer_id,
  {round2(f'greatest(5.0::DOUBLE, least(800.0::DOUBLE, {_NORMAL}))')} AS amount,
  strftime({h_date(_K, 140, '2023-01-01', '2024-06-30')}, '%Y-%m-%d') AS tx_date, {h_choice(_K, 141, G.TX_CATEGORIES)} AS category,
  {h_choice(_K, 142, G.TX_COUNTRIES)} AS country, {h_choice(_K, 143, G.TX_STATUSES)} AS status FROM orders""")
_N999 = f"({h_choice(_K, 1002, G.FIRST_NAMES)} || ' ' || {h_choice(_K, 1003, G.LAST_NAMES)})"
oracle("generate_source_block", f"n AS (SELECT *, {_N999} AS nm FROM orders)", f"""SELECT {_K} AS id, {h_int(_K, 999, 2001, 3001)} AS customer_id,
  nm AS full_name, {email('nm')} AS contact_email, {h_uniform(_K, 1000, 100.0, 5000.0)} AS value, {h_choice(_K, 1004, G.MERGE_CURRENCIES)} AS currency,
  strftime({h_date(_K, 1001, '2022-01-01', '2024-06-30')}, '%m/%d/%Y') AS purchase_date, {h_choice(_K, 1005, G.MERGE_PRODUCTS)} AS product,
  {h_choice(_K, 1006, G.MERGE_REGIONS)} AS area FROM n""")

# -- reading, writing, order ------------------------------------------------------------------------------------------

oracle("csv_roundtrip", DIRTY, "SELECT * FROM dirty")
oracle("read_raw", "", """SELECT c_custkey AS row_id, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer""")
oracle("snapshot_versions", DIRTY, """SELECT count(*) AS "rows", count(price) AS prices, 0 AS step FROM dirty
  UNION ALL SELECT count(price), count(price), 1 FROM dirty""")
_KEPT = "FROM dirty WHERE price IS NOT NULL"
_CELLS = f"orderstatus, {num('price')} AS price, order_date"
oracle("versions_read", DIRTY, f"""SELECT 0 AS version, row_id, custkey, {_CELLS}, NULL::INTEGER AS flag FROM dirty
  UNION ALL SELECT 1, row_id, custkey, {_CELLS}, NULL {_KEPT} UNION ALL SELECT 2, row_id, coalesce(custkey, '0'), {_CELLS}, NULL {_KEPT}
  UNION ALL SELECT 3, row_id, coalesce(custkey, '0'), {_CELLS}, (row_id % 2 = 0)::INTEGER {_KEPT}""")
oracle("versions_stored", DIRTY, f"""SELECT 0 AS version, true AS complete, count(*) AS "rows", count(*) * 6 AS cells FROM dirty
  UNION ALL SELECT 1, false, count(*), count(*) FROM dirty WHERE price IS NULL
  UNION ALL SELECT 2, false, count(*), count(*) * 2 {_KEPT} AND custkey IS NULL
  UNION ALL SELECT 3, false, count(*), count(*) * 3 {_KEPT}""")
oracle("preview", DIRTY, "SELECT * FROM dirty ORDER BY row_id LIMIT 20")
oracle("positions", DIRTY, "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM dirty WHERE price IS NOT NULL")
oracle("rows_at_positions", DIRTY + """, kept AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM dirty WHERE price IS NOT NULL),
  wanted AS (SELECT DISTINCT sum(event_id) % (SELECT count(*) FROM orders) AS position FROM events GROUP BY user_id % 50)""",
       "SELECT position::BIGINT AS position, row_id FROM kept WHERE position IN (SELECT position FROM wanted)")
_GONE = h_selected("row_id", 90, 0.1)
oracle("align_rows", RAW, f"""SELECT row_id, orderstatus AS c_orderstatus, priority AS c_priority,
  CASE WHEN {_GONE} THEN '__MISSING__' ELSE orderstatus END AS w_orderstatus, CASE WHEN {_GONE} THEN '__MISSING__' ELSE price END AS w_price,
  CASE WHEN {_GONE} THEN '__MISSING__' ELSE '__MISSING_COL__' END AS w_priority FROM raw""")
oracle("coalesce_first", RAW, "SELECT row_id, price AS amount FROM raw")

# -- cleaning ---------------------------------------------------------------------------------------------------------

oracle("standardize_dates", RAW, "SELECT row_id, order_date FROM raw")
_LK = "(l_orderkey * 8 + l_linenumber)"
oracle("standardize_numeric", "", f"""SELECT l_orderkey AS row_id, l_linenumber,
  CASE WHEN {h_selected(_LK, 95, 0.05)} THEN NULL ELSE l_extendedprice::DECIMAL(18,2)::DOUBLE END AS price,
  CASE WHEN {h_selected(_LK, 96, 0.4)} THEN 'many' ELSE {money('l_quantity')} END AS quantity FROM lineitem""")
oracle("standardize_strings", PADDED, f"SELECT row_id, {strip('label')} AS label, {strip('segment')} AS segment, nation FROM padded")
oracle("standardize_all", DIRTY, f"""SELECT row_id, {num('custkey')} AS custkey, {strip('orderstatus')} AS orderstatus, {num('price')} AS price,
  order_date, {strip('priority')} AS priority FROM dirty""")
oracle("fill_mean", DIRTY, f"SELECT row_id, coalesce({num('price')}, (SELECT {round2('avg(' + num('price') + ')')} FROM dirty)) AS price FROM dirty")
oracle("fill_median", DIRTY, f"SELECT row_id, coalesce({num('price')}, (SELECT {round2('quantile_cont(' + num('price') + ', 0.5)')} FROM dirty)) AS price FROM dirty")
oracle("fill_mode", DIRTY, """SELECT row_id, coalesce(custkey, (SELECT custkey FROM dirty WHERE custkey IS NOT NULL GROUP BY custkey ORDER BY count(*) DESC, custkey LIMIT 1)) AS custkey FROM dirty""")
oracle("fill_mode_hot", f"""lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN {h_selected(_LK, 97, 0.05)} THEN 'unknown'
  WHEN NOT {h_selected(_LK, 98, 0.05)} THEN {_LK}::VARCHAR END AS label FROM lineitem)""", """SELECT l_orderkey, l_linenumber,
  coalesce(label, (SELECT label FROM lines WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)) AS label FROM lines""")
oracle("fill_live", DIRTY + f""", parts AS (SELECT *, ({h_int('row_id', 111, 0, 3)} + 1)::INTEGER AS increment FROM dirty),
before AS (""" + " UNION ALL ".join(f"""SELECT {i} AS i, (SELECT {round2('avg(' + num('price') + ')')} FROM parts WHERE increment < {i}) AS price,
  (SELECT {round2('quantile_cont(' + num('custkey') + ', 0.5)')} FROM parts WHERE increment < {i}) AS custkey,
  (SELECT orderstatus FROM parts WHERE increment < {i} AND orderstatus IS NOT NULL GROUP BY orderstatus ORDER BY count(*) DESC, orderstatus LIMIT 1) AS orderstatus""" for i in (1, 2, 3)) + ")",
       f"""SELECT row_id, coalesce({num('p.custkey')}, b.custkey) AS custkey, coalesce(p.orderstatus, b.orderstatus) AS orderstatus, coalesce({num('p.price')}, b.price) AS price,
  concat_ws(',', CASE WHEN {num('p.price')} IS NULL THEN 'price' END, CASE WHEN {num('p.custkey')} IS NULL THEN 'custkey' END, CASE WHEN p.orderstatus IS NULL THEN 'orderstatus' END) AS missing, increment
  FROM parts p JOIN before b ON b.i = increment""")
oracle("fill_drop", DIRTY, "SELECT row_id, orderstatus FROM dirty WHERE orderstatus IS NOT NULL")

_PCOL = h_choice(_K, 100, ("price", "price", "custkey", "priority", "absent"))
PATCHES = f"""patches AS (SELECT CASE WHEN {h_selected(_K, 104, 0.05)} THEN {_K} + 100000000 ELSE {_K} >> 1 END AS row_id, {_PCOL} AS col,
  CASE WHEN {h_selected(_K, 103, 0.1)} THEN 'abc' WHEN {_PCOL} = 'custkey' THEN {h_int(_K, 101, 1, 999)}::VARCHAR WHEN {_PCOL} = 'priority' THEN ' 9-NEW '
    ELSE '1,' || lpad({h_int(_K, 102, 0, 1000)}::VARCHAR, 3, '0') || '.255' END AS value, {_K} AS step FROM orders WHERE {h_selected(_K, 105, 0.2)}),
  fitted AS (SELECT *, CASE WHEN col = 'priority' THEN {strip('value')} WHEN col = 'custkey' THEN {num("replace(value, ',', '')")}::BIGINT::VARCHAR
    WHEN col = 'price' THEN {round2(num("replace(value, ',', '')"))}::VARCHAR END AS cast_value,
    row_id IN (SELECT row_id FROM raw) AS known FROM patches)"""
oracle("set_values_patch", RAW + ", " + PATCHES + """, good AS (SELECT row_id, col, arg_max(cast_value, step) AS v FROM fitted
  WHERE known AND cast_value IS NOT NULL GROUP BY row_id, col)""",
       """SELECT row_id, coalesce(c.v, custkey) AS custkey, orderstatus, coalesce(p.v, price) AS price, order_date, coalesce(r.v, priority) AS priority
  FROM raw LEFT JOIN (SELECT row_id, v FROM good WHERE col = 'custkey') c USING (row_id) LEFT JOIN (SELECT row_id, v FROM good WHERE col = 'price') p USING (row_id)
  LEFT JOIN (SELECT row_id, v FROM good WHERE col = 'priority') r USING (row_id)""")
_AVAILABLE = "[" + ", ".join(f"'{c}'" for c in RAW_COLUMNS) + "]"
_CAST_ERROR = """'Cannot cast ''' || value || ''' to numeric for column ''' || {col} || '''. Provide a plain number (e.g. ''29.99'').'"""
_PATCH_ERROR = f"""CASE WHEN col = 'absent' THEN {q("Column 'absent' not found. Available: " + _AVAILABLE)} WHEN NOT known THEN 'Row ' || row_id || ' not found.'
  WHEN cast_value IS NULL THEN {_CAST_ERROR.format(col='col')} END"""
oracle("set_values_report", RAW + ", " + PATCHES, f"""SELECT step, row_id, col AS "column", value, {_PATCH_ERROR} IS NULL AS success, {_PATCH_ERROR} AS error FROM fitted""")
oracle("last_write_wins", RAW + ", " + PATCHES, 'SELECT row_id, col AS "column", arg_max(value, step) AS value FROM patches GROUP BY row_id, col')
oracle("cast_like_column", RAW + ", " + PATCHES, """SELECT step, col AS "column", cast_value, cast_value IS NOT NULL AS ok FROM fitted WHERE col <> 'absent'""")

_DROP = f"(amount > 700 OR {h_selected('row_id', 110, 0.05)})"
oracle("drop_rows", ACCOUNTS, f"SELECT row_id, tx_id, amount, segment FROM accounts WHERE NOT {_DROP}")
oracle("drop_rows_protected", ACCOUNTS, f"SELECT row_id, tx_id, extreme AS dropped_protected FROM accounts WHERE {_DROP}")


def _nearest(x: str, max_dist: int) -> str:
    domain = "[" + ", ".join(f"'{s}'" for s in T.SEGMENTS) + "]"
    ranked = f"list_sort(list_transform({domain}, lambda v: {{'d': levenshtein({x}, v), 'v': v}}))[1]"
    return f"(CASE WHEN {ranked}.d <= {max_dist} THEN {ranked}.v ELSE {x} END)"


oracle("fix_categories", BAD_ACCOUNTS, f"SELECT row_id, {_nearest('segment', 2)} AS segment FROM bad")
oracle("fix_categories_table", """lost AS (SELECT *, substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) AS short FROM part),
  labelled AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN short WHEN p_partkey % 5 = 1 THEN p_name || 'x' WHEN p_partkey % 7 = 2 THEN 'q' || short
    WHEN p_partkey % 11 = 3 THEN p_name || ' unknown' ELSE p_name END AS label FROM lost),
  texts AS (SELECT DISTINCT label, trim(label) AS t FROM labelled), names AS (SELECT DISTINCT p_name AS v FROM part),
  near AS (SELECT label, v, levenshtein(t, v) AS d FROM texts, names WHERE levenshtein(t, v) <= 2),
  best AS (SELECT label, v FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, v) = 1)""",
       "SELECT p_partkey, coalesce(v, l.label) AS label FROM labelled l LEFT JOIN best b USING (label)")
oracle("column_medians", "", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(median({c}), 6) AS median FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
oracle("inject_listed_typos", ACCOUNTS, f"""SELECT row_id, 'segment' AS "column", 'typo' AS kind, true AS filled, segment AS clean_value
  FROM accounts WHERE {h_selected('row_id', 310, 0.1)}""")
_KNOWN = " ".join(f"WHEN segment = {q(w)} THEN {q(v)}" for v, ws in T.SEGMENT_TYPOS.items() for w in ws)
oracle("typo_lookup", BAD_ACCOUNTS, f"SELECT row_id, CASE {_KNOWN} ELSE segment END AS segment FROM bad")
oracle("row_excess", COPIES, 'SELECT count(*) AS "rows", (SELECT count(*) FROM made) AS excess FROM copies')
oracle("live_ids", DIRTY, f"SELECT DISTINCT {num('custkey')}::BIGINT AS custkey FROM dirty WHERE {num('custkey')} IS NOT NULL")
oracle("outlier_range", BAD_ACCOUNTS, "SELECT row_id, amount FROM bad WHERE amount::DOUBLE BETWEEN 0 AND 2000")
oracle("outlier_cap", BAD_ACCOUNTS, "SELECT row_id, greatest(5.0::DOUBLE, least(800.0::DOUBLE, amount::DOUBLE)) AS amount FROM bad")
oracle("outlier_zscore", "z AS (SELECT event_id, value, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM events)",
       f"SELECT event_id, value, {round4('z')} AS z FROM z WHERE abs(z) > 3.0")

# -- merge and copies -------------------------------------------------------------------------------------------------

_CANON = "record_id, customer_id, full_name, email, amount, currency, {date} AS purchase_date, product_name, region"
oracle("conform_sources", MERGED, f"SELECT {_CANON.format(date=chr(39).join(['strftime(day, ', '%Y-%m-%d', ')']))} FROM merged")
_BY_SOURCE = "CASE src WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%m/%d/%Y') ELSE strftime(day, '%d.%m.%Y') END"
oracle("coalesce_aliases", MERGED, f"""SELECT record_id AS row_id, record_id::VARCHAR AS record_id, customer_id::VARCHAR AS customer_id, full_name, email,
  {money('amount')} AS amount, currency, {_BY_SOURCE} AS purchase_date, product_name, region FROM merged""")
oracle("union_ragged", "", "SELECT o_orderkey AS row_id, 9 AS filled, 27 AS raw_columns FROM orders")
_ALIASES = ", ".join(f"({i}, '{a}', '{c}')" for i, m in enumerate(G.SOURCE_ALIASES.values()) for c, a in m.items())
oracle("alias_lookup", "", f"""SELECT m.alias, m.canonical, count(*) AS cells FROM orders JOIN (VALUES {_ALIASES}) m(src, alias, canonical) ON o_orderkey % 3 = m.src
  GROUP BY m.alias, m.canonical""")
oracle("dedup_exact", COPIES, "SELECT min(row_id) AS row_id, custkey, orderstatus, amount, order_date, priority FROM copies GROUP BY ALL")
oracle("dedup_exact_documents", "", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
_CENTS = "round({x} * 100)::BIGINT"
_GAP = f"abs({_CENTS.format(x='b.amount')} - {_CENTS.format(x='a.amount')})"
_BLOCK = "a.custkey = b.custkey AND a.orderstatus = b.orderstatus AND a.order_date = b.order_date AND a.priority = b.priority"
oracle("dedup_near", COPIES, f"""SELECT * FROM copies b WHERE NOT EXISTS (SELECT 1 FROM copies a WHERE {_BLOCK} AND a.row_id < b.row_id
  AND 100 * {_GAP} <= {_CENTS.format(x='a.amount')} + 50)""")
oracle("near_duplicates_wide", COPIES, f"""SELECT min(a.row_id) AS original_id, b.row_id AS duplicate_id FROM copies a JOIN copies b
  ON a.orderstatus = b.orderstatus AND a.priority = b.priority AND a.row_id < b.row_id AND 10000 * {_GAP} <= {_CENTS.format(x='a.amount')} + 5000 GROUP BY b.row_id""")
oracle("dedup_by_key", COPIES, "SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY custkey, order_date ORDER BY row_id) = 1")
oracle("duplicate_pairs", "", """SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS original_id, doc_id AS duplicate_id FROM documents) WHERE original_id < duplicate_id""")
oracle("exclude_rows", RAW, "SELECT row_id, price FROM raw WHERE price::DOUBLE <= 250000")

# -- comparison with the truth ----------------------------------------------------------------------------------------

oracle("count_dirty_cells", DIRTY, "SELECT " + " + ".join(
    f"count(*) FILTER (d.{c} IS DISTINCT FROM r.{c})" for c in RAW_COLUMNS) + " AS dirty_cells FROM dirty d JOIN raw r USING (row_id)")
_NORMS = {"custkey": numeric_text, "orderstatus": plain_text, "price": numeric_text, "order_date": date_text, "priority": plain_text}


def _match(pairs: str, total: str) -> str:
    hits = " + ".join(
        f"coalesce((here AND {f('w_' + c)} = {f('c_' + c)})::INTEGER, 0)" for c, f in _NORMS.items()
    )
    m, t = "sum(m)::BIGINT", f"({total})"
    ratio = f"(sum(m) / {t}::DOUBLE)"
    return f"""SELECT {round4(ratio)} AS score, {t} - {m} AS issues_remaining, {m} || '/' || {t} || ' cells correct (' || {fixed(ratio + ' * 100', 1)}
      || '%) — ' || ({t} - {m}) || ' still need fixing.' AS detail, {round4(ratio)} AS cell_match_ratio, {m} AS cells_matched, {t} AS total_cells,
      {t} - {m} AS cells_mismatched FROM (SELECT {hits} AS m FROM ({pairs}))"""


_SIDES = ", ".join(f"w.{c} AS w_{c}, c.{c} AS c_{c}" for c in RAW_COLUMNS)
_TOTAL = f"(SELECT count(*) * {len(RAW_COLUMNS)} FROM raw)"
oracle("grade_cells", DIRTY, _match(
    f"SELECT {_SIDES}, w.row_id IS NOT NULL AS here FROM raw c LEFT JOIN (SELECT * FROM dirty WHERE price IS NOT NULL) w USING (row_id)", _TOTAL))
_PLACED = "(SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM {t})"
oracle("grade_cells_positional", DIRTY, _match(
    f"SELECT {_SIDES}, w.place IS NOT NULL AS here FROM {_PLACED.format(t='raw')} c LEFT JOIN {_PLACED.format(t='dirty WHERE price IS NOT NULL')} w USING (place)", _TOTAL))

_LATE = "((row_id >> 8) % 20 = 3)"
MENDED = DIRTY + f", mended AS (SELECT * FROM dirty WHERE {_LATE} AND row_id % 11 <> 0 UNION ALL SELECT * FROM raw WHERE NOT {_LATE})"
oracle("grade_cells_ranges", MENDED, _match(f"SELECT {_SIDES}, w.row_id IS NOT NULL AS here FROM raw c LEFT JOIN mended w USING (row_id)", _TOTAL))
oracle("count_dirty_cells_ranges", MENDED, "SELECT " + " + ".join(
    f"count(*) FILTER (d.{c} IS DISTINCT FROM r.{c})" for c in RAW_COLUMNS) + " AS dirty_cells FROM mended d JOIN raw r USING (row_id)")
_CHANGED = ", ".join(f"CASE WHEN m.row_id IS NOT NULL AND m.{c} IS DISTINCT FROM r.{c} THEN '{c}' END" for c in RAW_COLUMNS)
oracle("changed_cells", MENDED, f"""SELECT * FROM (SELECT row_id, concat_ws(',', {_CHANGED}) AS changed, m.row_id IS NULL AS gone
  FROM raw r LEFT JOIN mended m USING (row_id)) WHERE gone OR changed <> ''""")
_EMPTY = f"0.0::DOUBLE AS score, 0::BIGINT AS issues_remaining, {q(Q.EMPTY_DETAIL)} AS detail"
oracle("grade_dispatch", DIRTY, f"""SELECT 'easy' AS "case", score, issues_remaining, detail FROM ({_match(
    f"SELECT {_SIDES}, w.place IS NOT NULL AS here FROM {_PLACED.format(t='raw')} c LEFT JOIN {_PLACED.format(t='dirty WHERE price IS NOT NULL')} w USING (place)",
    _TOTAL)}) UNION ALL SELECT 'easy, empty', {_EMPTY} UNION ALL SELECT 'medium, empty', {_EMPTY}""")

_F1 = "(2 * p * r / (p + r + 1e-9::DOUBLE))"


def _items(category: str) -> str:
    return f"""work AS (SELECT row_id, tx_id, amount::DOUBLE AS amount, {category} AS segment FROM bad WHERE amount::DOUBLE BETWEEN 0 AND 1500),
  items AS (SELECT 'outlier' AS kind, c.tx_id, w.row_id IS NULL OR w.amount BETWEEN 5 AND 800 AS ok FROM bad_k k JOIN accounts c USING (row_id) LEFT JOIN work w USING (row_id) WHERE k.k_amount IS NOT NULL
    UNION ALL SELECT 'extreme', c.tx_id, coalesce(w.amount BETWEEN c.amount * 0.95::DOUBLE AND c.amount * 1.05::DOUBLE, false) FROM accounts c LEFT JOIN work w USING (row_id) WHERE c.extreme
    UNION ALL SELECT 'typo', c.tx_id, coalesce({strip('w.segment')} = c.segment, false) FROM bad_k k JOIN accounts c USING (row_id) LEFT JOIN work w USING (row_id) WHERE k.k_segment IS NOT NULL)"""


oracle("grade_outliers_typos", BAD_ACCOUNTS + ", " + _items(_nearest("segment", 1)) + """,
  n AS (SELECT count(*) FILTER (kind = 'outlier' AND ok) AS tp, count(*) FILTER (kind = 'outlier' AND NOT ok) AS fn, count(*) FILTER (kind = 'extreme' AND NOT ok) AS fp,
    count(*) FILTER (kind = 'typo' AND ok) AS fixed, count(*) FILTER (kind = 'typo') AS typos FROM items),
  pr AS (SELECT *, tp / (tp + fp + 1e-9::DOUBLE) AS p, tp / (tp + fn + 1e-9::DOUBLE) AS r, fixed / greatest(typos, 1)::DOUBLE AS ts FROM n),""" +
       f" s AS (SELECT *, {_F1} AS f, 0.5::DOUBLE * {_F1} + 0.5::DOUBLE * ts AS sc FROM pr)", f"""SELECT {round4('sc')} AS score, fn + (typos - fixed) AS issues_remaining,
  'Outlier F1=' || {fixed('f', 3)} || ' (TP=' || tp || ', FP=' || fp || ', FN=' || fn || ') | Typos ' || fixed || '/' || typos || ' fixed → score=' || {fixed('sc', 3)} AS detail,
  {round4('f')} AS outlier_f1, tp AS outlier_tp, fn AS outlier_fn, fp AS outlier_fp, {round4('p')} AS precision, {round4('r')} AS recall, {round4('ts')} AS typo_score,
  fixed AS typos_fixed, typos AS typos_total, {round4('sc')} AS combined FROM s""")
oracle("truth_outcomes", BAD_ACCOUNTS + ", " + _items("segment"), "SELECT * FROM items")
oracle("row_loss", BAD_ACCOUNTS, """SELECT count(*) AS rows_lost FROM bad b JOIN bad_k k USING (row_id) WHERE b.amount::DOUBLE NOT BETWEEN 0 AND 1500 AND k.k_amount IS NULL""")

_PD = "CASE WHEN row_id % 7 = 0 THEN strftime(order_date::DATE, '%m/%d/%Y') ELSE order_date END"
oracle("grade_schema_dedup_dates", COPIES + f""",
  work AS (SELECT {_PD} AS purchase_date FROM copies WHERE amount IS NOT NULL AND NOT {h_selected('row_id', 120, 0.03)}),
  c AS (SELECT count(*) AS n, count(purchase_date) AS t, count(*) FILTER (regexp_full_match(purchase_date, '{PLAUSIBLE}-[0-9]{{2}}-[0-9]{{2}}')) AS v,
    (SELECT count(*) FROM base) AS nc, (SELECT count(*) FROM made) AS k FROM work),
  d AS (SELECT *, greatest(0, nc + k - n) AS removed, least(greatest(0, nc + k - n), k) AS td, greatest(0, greatest(0, nc + k - n) - k) AS od, 3 / 9::DOUBLE AS sch, v / t::DOUBLE AS fm FROM c),
  pr AS (SELECT *, greatest(0, td - od) / (removed + 1e-9::DOUBLE) AS p, td / (k + 1e-9::DOUBLE) AS r FROM d),
  s AS (SELECT *, {_F1} AS f, 0.4::DOUBLE * sch + 0.35::DOUBLE * {_F1} + 0.25::DOUBLE * fm AS sc FROM pr)""",
       f"""SELECT {round4('sc')} AS score, 6 + greatest(0, n - nc) AS issues_remaining,
  'Schema=' || {fixed('sch', 3)} || ' | Dedup=' || {fixed('f', 3)} || ' | DateFmt=' || {fixed('fm', 3)} || ' → score=' || {fixed('sc', 3)} AS detail,
  {round4('sch')} AS schema_score, {round4('f')} AS dedup_score, {round4('fm')} AS format_score, {round4('sc')} AS combined,
  3 AS schema_canonical_found, 9 AS schema_canonical_total, 2 AS schema_leftover_aliases, 0.0::DOUBLE AS schema_rename_bonus,
  removed AS dedup_rows_removed, td AS dedup_true_dups_removed, od AS dedup_over_deletion, {round4('p')} AS dedup_precision, {round4('r')} AS dedup_recall, {round4('f')} AS dedup_f1,
  true AS fmt_date_col_found, 'purchase_date' AS fmt_date_col_used, t AS fmt_n_total, v AS fmt_n_valid_iso, v AS fmt_n_year_ok, {round4('fm')} AS fmt_valid_ratio FROM s""")
_LEFT = f"NOT {h_selected('{x}', 121, 0.3)}"
oracle("grade_dedup_identity", COPIES + f""",
  st AS (SELECT {_LEFT.format(x='original_id')} AS o, {_LEFT.format(x='row_id')} AS d FROM made),
  n AS (SELECT count(*) AS copies, count(*) FILTER (o <> d) AS tp, count(*) FILTER (NOT o AND NOT d)
    + (SELECT count(*) FROM base WHERE NOT ({_LEFT.format(x='row_id')}) AND row_id NOT IN (SELECT original_id FROM made)) AS fp FROM st),
  pr AS (SELECT *, tp / (tp + fp + 1e-9::DOUBLE) AS p, tp / (copies + 1e-9::DOUBLE) AS r FROM n)""",
       f"SELECT copies, tp AS copies_removed, fp AS originals_lost, {round4('p')} AS precision, {round4('r')} AS recall, {round4(_F1)} AS f1 FROM pr")

# -- action logs ------------------------------------------------------------------------------------------------------

_RK = "coalesce(json_extract_string(props, '$.k'), '0')::BIGINT"
# What each of the forms must be read as, by the rules of the parser: (command, row, column, value, strategy).
_READ = {
    0: ("SET_VALUE", _RK, "'price'", money("value"), None), 1: ("SET_VALUE", _RK, "'quantity'", money("value"), None),
    2: ("DROP_ROW", _RK, None, None, None), 3: ("STANDARDIZE_COL", None, "'order_date'", None, None),
    4: ("FILL_MISSING", None, "'quantity'", None, "'median'"), 10: ("SET_VALUE", _RK, "'price'", "'29.5'", None),
    13: ("SET_VALUE", _RK, "'price'", "'True'", None), 14: ("FILL_MISSING", None, "'price'", None, "'mode'"),
}


def _read(i: int, kind: str, other: str = "NULL") -> str:
    return "CASE event_id % 17 " + " ".join(f"WHEN {n} THEN {r[i] or 'NULL'}" for n, r in _READ.items()) + f" ELSE {other} END::{kind}"


oracle("parse_responses", "", "SELECT event_id, CASE event_id % 17 " + " ".join(f"WHEN {n} THEN '{r[0]}'" for n, r in _READ.items()) +
       f""" ELSE 'DONE' END AS command, {_read(1, 'BIGINT')} AS row_index, {_read(2, 'VARCHAR')} AS "column", {_read(3, 'VARCHAR')} AS value,
  {_read(4, 'VARCHAR')} AS fill_strategy FROM events""")


def _requires(*fields: str) -> str:
    parts = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f.strip(chr(34))}' END" for f in fields)
    anyone = " OR ".join(f"{f} IS NULL" for f in fields)
    return f"CASE WHEN {anyone} THEN command || ' requires: ' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ', ') END"


oracle("validate_actions", ACTIONS + f""", checked AS (SELECT *, CASE
    WHEN command NOT IN ('SET_VALUE', 'DROP_ROW', 'STANDARDIZE_COL', 'FILL_MISSING', 'DONE') THEN 'command must be one of: SET_VALUE, DROP_ROW, STANDARDIZE_COL, FILL_MISSING, DONE'
    WHEN row_index < 0 THEN 'row_index must be >= 0, got ' || row_index WHEN "column" = '' THEN 'column must not be empty'
    WHEN fill_strategy NOT IN ('mean', 'median', 'mode', 'drop') THEN 'fill_strategy must be one of: mean, median, mode, drop'
    WHEN command = 'SET_VALUE' THEN {_requires('row_index', '"column"', 'value')} WHEN command = 'DROP_ROW' AND row_index IS NULL THEN 'DROP_ROW requires row_index'
    WHEN command = 'STANDARDIZE_COL' AND "column" IS NULL THEN 'STANDARDIZE_COL requires column'
    WHEN command = 'FILL_MISSING' THEN {_requires('"column"', 'fill_strategy')} END AS error FROM log)""", "SELECT *, error IS NULL AS valid FROM checked")
oracle("row_in_range", SCALED, "SELECT episode_id, step, row_index, row_index >= 0 AND row_index < (SELECT count(*) FROM supplier) AS in_range FROM log")


def _place(o: str, n: str) -> str:
    return f"CASE WHEN {o}.row_index < {n} - len(w.dropped) THEN list_reduce(list_prepend({o}.row_index, w.dropped), lambda a, d: a + CASE WHEN d <= a THEN 1 ELSE 0 END) END"


def _walk(ops: str, starts: str, n: str, last: str) -> str:
    """Recursion over steps with the list of places dropped so far."""
    place = _place("o", n)
    return f"""walk AS (SELECT episode_id, 0 AS step, []::BIGINT[] AS dropped, NULL::BIGINT AS position, 0::BIGINT AS gone FROM ({starts})
    UNION ALL SELECT episode_id, step, CASE WHEN is_drop AND place IS NOT NULL THEN list_sort(list_append(dropped, place)) ELSE dropped END, place, len(dropped)
    FROM (SELECT w.episode_id, w.step + 1 AS step, w.dropped, coalesce(o.command = 'DROP_ROW', false) AS is_drop, {place} AS place
      FROM walk w LEFT JOIN {ops} o ON o.episode_id = w.episode_id AND o.step = w.step + 1 WHERE w.step < {last}))"""


oracle("resolve_positions", SCALED + """, ops AS (SELECT * FROM log WHERE command IN ('SET_VALUE', 'DROP_ROW') AND row_index >= 0), """ +
       _walk("ops", "SELECT DISTINCT episode_id FROM log", "(SELECT count(*) FROM supplier)", "(SELECT max(step) FROM log)"),
       """SELECT l.episode_id, l.step, l.command, l.row_index, true AS executed, w.position,
  CASE WHEN o.step IS NOT NULL THEN w.position IS NOT NULL END AS in_range
  FROM log l LEFT JOIN ops o USING (episode_id, step) LEFT JOIN walk w USING (episode_id, step)""", recursive=True)

oracle("resolve_positions_hot", f"""log AS (SELECT event_id AS step, CASE WHEN event_id % 100 = 7 THEN 'DROP_ROW' ELSE 'SET_VALUE' END AS command,
    {h_int('event_id', 67, 0, 1 << 30)} % ((SELECT count(*) FROM orders) + 2) AS row_index FROM events),
  drops AS (SELECT 'all' AS episode_id, row_number() OVER (ORDER BY step) AS step, command, row_index FROM log WHERE command = 'DROP_ROW'), """ +
       _walk("drops", "SELECT 'all' AS episode_id", "(SELECT count(*) FROM orders)", "(SELECT count(*) FROM drops)") +
       """, behind AS (SELECT *, coalesce(sum((command = 'DROP_ROW')::INTEGER) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM log),
  placed AS (SELECT b.*, """ + _place("b", "(SELECT count(*) FROM orders)") + """ AS position FROM behind b JOIN walk w ON w.step = b.k)""",
       "SELECT step, command, row_index, true AS executed, position, position IS NOT NULL AS in_range FROM placed", recursive=True)

APPLY = DIRTY + """, folded AS (SELECT event_id % 200 AS g, sum(event_id) AS s, sum(value)::DECIMAL(18,2)::VARCHAR AS v FROM events GROUP BY 1),
  edits AS (SELECT 'one' AS episode_id, (g + 1)::INTEGER AS step, CASE WHEN g % 4 = 3 THEN 'DROP_ROW' ELSE 'SET_VALUE' END AS command,
    CASE WHEN g % 10 = 9 THEN 1000000000000 ELSE s % (SELECT count(*) FROM orders) END::BIGINT AS row_index,
    CASE WHEN g % 4 = 3 THEN NULL WHEN g % 5 = 0 THEN 'priority' WHEN g % 11 = 0 THEN 'absent' ELSE 'price' END AS col,
    CASE WHEN g % 4 = 3 THEN NULL WHEN g % 13 = 0 THEN 'abc' ELSE v END AS value FROM folded),
  ops AS (SELECT * FROM edits WHERE col IS DISTINCT FROM 'absent'),
  """ + _walk("ops", "SELECT 'one' AS episode_id", "(SELECT count(*) FROM dirty)", "(SELECT count(*) FROM folded)") + """,
  placed AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM dirty),
  done AS (SELECT e.*, p.row_id, w.gone, w.position FROM edits e LEFT JOIN walk w ON w.step = e.step LEFT JOIN placed p USING (position))"""
_FIT = f"CASE WHEN col = 'priority' THEN {strip('value')} ELSE {round2(num('value'))}::VARCHAR END"
oracle("apply_actions", APPLY + f""", fit AS (SELECT row_id, col, arg_max(v, step) AS v FROM (SELECT *, {_FIT} AS v FROM done WHERE command = 'SET_VALUE' AND row_id IS NOT NULL) WHERE v IS NOT NULL GROUP BY row_id, col),
  edited AS (SELECT row_id, custkey, orderstatus, coalesce(p.v, price) AS price, order_date, coalesce(r.v, priority) AS priority FROM dirty
    LEFT JOIN (SELECT row_id, v FROM fit WHERE col = 'price') p USING (row_id) LEFT JOIN (SELECT row_id, v FROM fit WHERE col = 'priority') r USING (row_id)
    WHERE row_id NOT IN (SELECT row_id FROM done WHERE command = 'DROP_ROW' AND row_id IS NOT NULL))""",
       f"""SELECT row_id, custkey, orderstatus, coalesce({num('price')}, (SELECT {round2('avg(' + num('price') + ')')} FROM edited)) AS price, order_date,
  {strip('priority')} AS priority FROM edited""", recursive=True)
_LIVE = "((SELECT count(*) FROM dirty) - gone)"
_APPLY_ERROR = f"""CASE WHEN col = 'absent' THEN {q("Column 'absent' not found. Available: " + _AVAILABLE)}
  WHEN position IS NULL THEN 'Row index ' || row_index || ' out of range. DataFrame has ' || {_LIVE} || ' rows' || CASE WHEN command = 'SET_VALUE' THEN ' (0–' || ({_LIVE} - 1) || ').' ELSE '.' END
  WHEN command = 'SET_VALUE' AND col = 'price' AND {num('value')} IS NULL THEN {_CAST_ERROR.format(col='col')} END"""
oracle("apply_actions_report", APPLY, f"""SELECT step, command, {_APPLY_ERROR} IS NULL AS success, {_APPLY_ERROR} AS error,
    coalesce(command = 'DROP_ROW' AND (SELECT custkey FROM dirty x WHERE x.row_id = done.row_id) IN (SELECT custkey FROM dirty WHERE row_id % 5 = 0 AND custkey IS NOT NULL), false) AS dropped_protected FROM done
  UNION ALL SELECT (SELECT count(*) FROM folded)::INTEGER + 1, 'STANDARDIZE_COL', true, NULL, false UNION ALL SELECT (SELECT count(*) FROM folded)::INTEGER + 2, 'FILL_MISSING', true, NULL, false""", recursive=True)

# -- episodes ---------------------------------------------------------------------------------------------------------

oracle("step_rewards", STEPS, "SELECT episode_id, step, command, score, prev_score, reward, done FROM rewarded")
_BROKEN = "array_to_string(list_transform((['a','b','c','d','e'])[1:least(5, user_id % 8)], lambda x: '''' || x || ''''), ', ')"
_REFUSED = "prev_score < threshold"
oracle("done_gate", STEPS, f"""SELECT episode_id, step, NOT ({_REFUSED}) AS accepted, reward, done,
  CASE WHEN {_REFUSED} THEN 'DONE rejected: score ' || format('{{:.4f}}', prev_score) || ' < required ' || format('{{:.2f}}', threshold) || '. Still broken: [' || coalesce({_BROKEN}, '') || ']' END AS error,
  CASE WHEN {_REFUSED} THEN initial_dirty - floor(prev_score * initial_dirty) ELSE 0 END::BIGINT AS issues_remaining,
  coalesce(array_to_string((['a','b','c','d','e','f','g'])[1:user_id % 8], ','), '') AS still_broken FROM rewarded WHERE command = 'DONE' AND prev_score IS NOT NULL""")
oracle("termination", STEPS, "SELECT episode_id, end_step, score >= threshold AS solved FROM ended WHERE step = end_step")
oracle("cut_at_terminal", STEPS, "SELECT episode_id, step, score, done FROM cut")
oracle("episode_totals", STEPS, f"SELECT episode_id, max(step) AS steps, arg_max(score, step) AS score, {round4('coalesce(sum(reward), 0)')} AS total_reward FROM rewarded GROUP BY episode_id")
oracle("episode_summary", STEPS, f"""SELECT episode_id, task_id, arg_max(score, step) >= max(threshold) AS success, max(step)::BIGINT AS steps, arg_max(score, step) AS score,
  {round4('coalesce(sum(reward), 0)')} AS total_reward, coalesce(string_agg(reward::DECIMAL(10,4)::VARCHAR, ',' ORDER BY step), '') AS rewards FROM cut GROUP BY episode_id, task_id""")
oracle("episode_rewards", STEPS, "SELECT episode_id, task_id, step, score, reward, done FROM cut")
oracle("step_position", STEPS, "SELECT episode_id, step, row_number() OVER (PARTITION BY episode_id ORDER BY step) AS step_number, greatest(0, max_steps - step) AS remaining FROM log")
oracle("current_state", STEPS, """SELECT episode_id, task_id, arg_max(score, step) AS current_score, greatest(0, any_value(max_steps) - max(step))::BIGINT AS steps_remaining,
  arg_max(score, step) >= any_value(threshold) AS is_solved FROM log GROUP BY episode_id, task_id""")
oracle("recent_actions", STEPS, """SELECT episode_id, step, coalesce(array_to_string(list_filter(l, lambda x: x IS NOT NULL), ','), '') AS recent
  FROM (SELECT episode_id, step, list(command) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l FROM log)""")
oracle("plan_applied", DIRTY + ", placed AS (SELECT row_id, price, row_number() OVER (ORDER BY row_id) - 1 AS p FROM dirty)",
       """SELECT row_id, coalesce((SELECT (1000 + max(i))::VARCHAR || '.5' FROM range(160) t(i) WHERE i * (SELECT count(*) FROM orders) // 160 = p), price) AS price
  FROM placed WHERE p > 0""")
_NUMERIC = f"(SELECT count({num('price')}) > 0 FROM dirty)"
oracle("check_fill", DIRTY, f"""SELECT 'price' AS "column", 'mean' AS strategy, {_NUMERIC} AS success, NULL::VARCHAR AS error
  UNION ALL SELECT 'price', 'median', {_NUMERIC}, NULL UNION ALL SELECT 'priority', 'mean', false, {q("Cannot compute mean for non-numeric column 'priority'.")}
  UNION ALL SELECT 'priority', 'mode', (SELECT count(priority) > 0 FROM dirty), NULL UNION ALL SELECT 'priority', 'zero', false, {q("Unknown fill_strategy: 'zero'")}
  UNION ALL SELECT 'orderstatus', 'drop', true, NULL""")
oracle("inject_listed_rows", ACCOUNTS, f"""SELECT row_id, 'amount' AS "column", 'outlier' AS kind, {outlier('row_id', 301)}::DOUBLE AS dirty, amount::DOUBLE AS clean
  FROM accounts WHERE {h_selected('row_id', 300, 0.1)}""")
