"""Cleansing rules written a second time, for the checking database."""

from __future__ import annotations

NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
MONTHS = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"


def alnum(x: str) -> str:
    return f"regexp_replace({x}, '[^A-Za-z0-9]', '', 'g')"


def customer_id(x: str) -> str:
    a = alnum(x)
    return f"(case when {a} = '' then null when regexp_matches({a}, '^[0-9]+$') then coalesce(nullif(ltrim({a}, '0'), ''), '0') else {a} end)"


def account_no(x: str) -> str:
    return f"nullif({alnum(x)}, '')"


def branch_code(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"(case when trim({x}) = '' then null when {d} = '' then trim({x}) else right('00000' || {d}, 5) end)"


def amount(x: str) -> str:
    t = f"trim({x})"
    unsigned = f"regexp_replace(regexp_replace({t}, '[+-]$', ''), '^[+-]', '')"
    b = f"replace(replace(replace(replace({unsigned}, ',', ''), ' ', ''), '$', ''), '₹', '')"
    sign = f"(case when starts_with({t}, '-') or ends_with({t}, '-') then -1 else 1 end)"
    return (
        f"(case when upper({t}) in ('', 'N/A', '-', '.') or not regexp_matches({b}, '{NUMBER}') then null "
        f"else {sign} * try_cast({b} as decimal(18,2)) end)"
    )


def day(x: str) -> str:
    t = f"trim({x})"
    p = f"string_split({t}, '-')"
    month = f"list_position({MONTHS}, upper({p}[2]))"
    y = f"try_cast({p}[3] as int)"
    year = f"(case when {y} <= 49 then 2000 + {y} when {y} < 100 then 1900 + {y} else {y} end)"
    return (
        f"(case when regexp_matches({t}, '^[0-9]+/[0-9]+/[0-9]{{4}}$') then cast(try_strptime({t}, '%d/%m/%Y') as date) "
        f"when regexp_matches({t}, '^[0-9]{{1,2}}-[0-9]+-[0-9]{{4}}$') then cast(try_strptime({t}, '%d-%m-%Y') as date) "
        f"when regexp_matches({t}, '^[0-9]{{4}}-[0-9]+-[0-9]+$') then cast(try_strptime({t}, '%Y-%m-%d') as date) "
        f"when {month} > 0 and {year} between 1900 and 2099 then "
        f"cast(try_strptime({year} || '-' || {month} || '-' || {p}[1], '%Y-%m-%d') as date) end)"
    )


def _words(x: str) -> str:
    t = f"replace(replace(upper(trim({x})), '-', ' '), '_', ' ')"
    return f"ltrim(regexp_replace(trim({t}), '^[0-9][0-9] ', ''))"


def asset_class(x: str) -> str:
    w = _words(x)
    return (
        f"(case when trim({x}) = '' then null when {w} in ('0', '00') then 'STANDARD' when {w} in ('1', '01') then 'SUB_STANDARD' "
        f"when {w} in ('2', '02') then 'DOUBTFUL' when {w} in ('3', '03', '4', '04') then 'LOSS' "
        f"when {w} like '%STANDARD%' and {w} not like '%SUB%' then 'STANDARD' "
        f"when {w} like '%SUB%STANDARD%' or {w} like '%SUB%STD%' then 'SUB_STANDARD' when {w} like '%DOUBT%' then 'DOUBTFUL' "
        f"when {w} like '%LOSS%' then 'LOSS' else {w} end)"
    )


def account_status(x: str) -> str:
    w = _words(x)
    return (
        f"(case when trim({x}) = '' then null when {w} like '%OPEN%' then 'OPEN' when {w} like '%CLOSE%' or {w} like '%CLSD%' then 'CLOSED' "
        f"when {w} like '%DORMANT%' or {w} like '%DRMNT%' then 'DORMANT' when {w} like '%FROZEN%' or {w} like '%FROZN%' then 'FROZEN' "
        f"when {w} like '%BLOCK%' then 'BLOCKED' when {w} like '%INOPER%' then 'INOPERATIVE' else {w} end)"
    )


def rate(x: str) -> str:
    return f"try_cast(nullif(regexp_extract(trim({x}), '^[0-9.]+'), '') as decimal(8,4))"


def plain_rate(x: str) -> str:
    return f"try_cast(trim({x}) as decimal(8,4))"


def rate_status(rate_text: str, status: str) -> str:
    tail = f"case when {rate_text} like '% %' then nullif(regexp_extract({rate_text}, '[A-Za-z].*$'), '') end"
    return account_status(f"coalesce(nullif(trim({status}), ''), {tail})")


def whole(x: str) -> str:
    return f"(case when trim({x}) = '' then 0 else try_cast(trim({x}) as int) end)"


def comma_free(x: str) -> str:
    return f"try_cast(replace(coalesce({x}, '0'), ',', '') as double)"


def as_printed(x: str) -> str:
    return f"try_cast({x} as double)"


def r2(x: str, digits: int = 2) -> str:
    return f"round(cast({x} as double), {digits})"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def iso(x: str) -> str:
    return f"cast({x} as varchar)"
