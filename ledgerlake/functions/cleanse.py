"""Cleansing rules for report text (account, customer, branch, money, date, classifications).

Each rule is one SQL expression over a column or expression ``x``. The same text backs the
Python helper and the SQL name (see ``register``), so both are inlined by Catalyst and
stay inside whole-stage code generation. Blanks inside patterns are written as character
classes so that no backslash is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number shape and month names of the source reports.
PLAIN_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"

# Most codes are all digits already: trimming digits off both ends tells, without a pattern.
_all_digits = "btrim({x}, '0123456789') = ''"
_alnum = f"CASE WHEN {_all_digits} THEN {{x}} ELSE regexp_replace({{x}}, '[^A-Za-z0-9]', '') END"
_digits = "regexp_replace({x}, '[^0-9]', '')"

CUSTOMER_ID = (
    f"CASE WHEN ({_alnum}) = '' THEN NULL "
    f"WHEN btrim({_alnum}, '0123456789') = '' THEN coalesce(nullif(trim(LEADING '0' FROM {_alnum}), ''), '0') "
    f"ELSE {_alnum} END"
)

ACCOUNT_NO = f"nullif({_alnum}, '')"

BRANCH_CODE = (
    "CASE WHEN trim({x}) = '' THEN NULL "
    f"WHEN {_all_digits} THEN right(concat('00000', {{x}}), 5) "
    f"WHEN {_digits} = '' THEN trim({{x}}) "
    f"ELSE right(concat('00000', {_digits}), 5) END"
)

# One sign is taken off each end, separators and currency signs are dropped; a minus on either end
# negates once. An exponent is turned into a letter that no number has.
_lead = "(CASE WHEN left(trim({x}), 1) IN ('+', '-') THEN 1 ELSE 0 END)"
_trail = "(CASE WHEN right(trim({x}), 1) IN ('+', '-') THEN 1 ELSE 0 END)"
_money_body = f"substring(trim({{x}}), 1 + {_lead}, length(trim({{x}})) - {_lead} - {_trail})"
for _char, _by in ((",", ""), (" ", ""), ("$", ""), ("₹", ""), ("e", "x"), ("E", "x")):
    _money_body = f"replace({_money_body}, '{_char}', '{_by}')"
_money = f"try_cast({_money_body} AS DECIMAL(18,2))"
AMOUNT = f"CASE WHEN startswith(trim({{x}}), '-') OR endswith(trim({{x}}), '-') THEN -{_money} ELSE {_money} END"

# Three parts between two separators; letters in the middle make it dd-MON-yy (two-digit years up to
# 49 are 20xx, the rest 19xx), a separator at the fifth place makes it ISO, else day first.
_day_text = "replace(trim({x}), '/', '-')"
_p1 = f"substring_index({_day_text}, '-', 1)"
_p2 = f"substring_index(substring_index({_day_text}, '-', 2), '-', -1)"
_p3 = f"substring_index({_day_text}, '-', -1)"
_parts = f"length({_day_text}) - length(replace({_day_text}, '-', ''))"
_year = f"try_cast({_p3} AS INT)"
_full_year = f"CASE WHEN {_year} <= 49 THEN 2000 + {_year} WHEN {_year} < 100 THEN 1900 + {_year} ELSE {_year} END"
_month = f"instr('{MONTHS}', upper({_p2}))"
DATE = (
    f"CASE WHEN {_parts} = 0 AND length({_day_text}) = 8 THEN try_to_date({_day_text}, 'yyyyMMdd') "
    f"WHEN {_parts} <> 2 THEN NULL "
    f"WHEN length({_p1}) = 4 THEN try_cast({_day_text} AS DATE) "
    f"WHEN btrim({_p2}, '0123456789') = '' THEN "
    f"CASE WHEN length({_p3}) = 4 THEN try_cast(concat_ws('-', {_p3}, {_p2}, {_p1}) AS DATE) END "
    f"WHEN length({_p2}) = 3 AND pmod({_month}, 3) = 1 AND {_full_year} BETWEEN 1900 AND 2099 "
    f"THEN try_cast(concat_ws('-', {_full_year}, ({_month} + 2) DIV 3, {_p1}) AS DATE) END"
)

# Dashes and underscores count as spaces; a leading two-digit code before text is dropped. The cleaned text
# stands in every condition, so that it is computed once per row.
_class_text = (
    "ltrim(regexp_replace(trim(replace(translate(upper(trim({x})), '-_', '  '), '  ', ' ')), '^[0-9]{{2}}(?= )', ''))"
)
ASSET_CLASS = (
    f"CASE WHEN {_class_text} = '' THEN CASE WHEN trim({{x}}) = '' THEN NULL ELSE '' END "
    f"WHEN {_class_text} IN ('0', '00') THEN 'STANDARD' "
    f"WHEN {_class_text} IN ('1', '01') THEN 'SUB_STANDARD' "
    f"WHEN {_class_text} IN ('2', '02') THEN 'DOUBTFUL' "
    f"WHEN {_class_text} IN ('3', '4', '03', '04') THEN 'LOSS' "
    f"WHEN {_class_text} RLIKE 'SUB.*(STANDARD|STD)' THEN 'SUB_STANDARD' "
    f"WHEN {_class_text} LIKE '%STANDARD%' AND {_class_text} NOT LIKE '%SUB%' THEN 'STANDARD' "
    f"WHEN {_class_text} LIKE '%DOUBT%' THEN 'DOUBTFUL' "
    f"WHEN {_class_text} LIKE '%LOSS%' THEN 'LOSS' "
    f"ELSE {_class_text} END"
)

_status_text = "ltrim(regexp_replace(trim(translate(upper(trim({x})), '-_', '  ')), '^[0-9]{{2}}(?= )', ''))"
ACCOUNT_STATUS = (
    f"CASE WHEN {_status_text} = '' THEN CASE WHEN trim({{x}}) = '' THEN NULL ELSE '' END "
    f"WHEN {_status_text} LIKE '%OPEN%' THEN 'OPEN' "
    f"WHEN {_status_text} RLIKE 'CLOSE|CLSD' THEN 'CLOSED' "
    f"WHEN {_status_text} RLIKE 'DORMANT|DRMNT' THEN 'DORMANT' "
    f"WHEN {_status_text} RLIKE 'FROZEN|FROZN' THEN 'FROZEN' "
    f"WHEN {_status_text} LIKE '%BLOCK%' THEN 'BLOCKED' "
    f"WHEN {_status_text} LIKE '%INOPER%' THEN 'INOPERATIVE' "
    f"ELSE {_status_text} END"
)

# Rate text: a plain number, or a number followed by other text ("8.00 OPEN").
RATE = (
    f"CASE WHEN trim({{x}}) RLIKE '{PLAIN_NUMBER}' THEN try_cast(trim({{x}}) AS DECIMAL(8,4)) "
    "ELSE try_cast(nullif(regexp_extract(trim({x}), '^([0-9.]+)', 1), '') AS DECIMAL(8,4)) END"
)
PLAIN_RATE = "try_cast(trim({x}) AS DECIMAL(8,4))"
STATUS_IN_RATE = "CASE WHEN {x} LIKE '% %' THEN nullif(regexp_extract({x}, '([A-Za-z].*)$', 1), '') END"

# Empty text counts as 0, other non-numbers as NULL.
WHOLE_NUMBER = "CASE WHEN trim({x}) = '' THEN 0 ELSE try_cast(trim({x}) AS INT) END"


def _rule(text: str):
    def helper(x: str) -> Column:
        return F.expr(text.format(x=x))

    return helper


customer_id = _rule(CUSTOMER_ID)
account_no = _rule(ACCOUNT_NO)
branch_code = _rule(BRANCH_CODE)
amount = _rule(AMOUNT)
date = _rule(DATE)
asset_class = _rule(ASSET_CLASS)
account_status = _rule(ACCOUNT_STATUS)
rate = _rule(RATE)
plain_rate = _rule(PLAIN_RATE)
whole_number = _rule(WHOLE_NUMBER)
trimmed = _rule("trim({x})")


def rate_status(rate_text: str, status_text: str) -> Column:
    """Status from its own column, else from the tail of the rate text."""
    inner = f"coalesce(nullif(trim({status_text}), ''), {STATUS_IN_RATE.format(x=rate_text)})"
    return F.expr(ACCOUNT_STATUS.format(x=inner))


def iso_day(x: str) -> Column:
    """``dd/MM/yyyy`` text as ISO text, for chart axes."""
    return F.date_format(date(x), "yyyy-MM-dd")
