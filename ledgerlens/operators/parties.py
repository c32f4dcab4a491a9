"""Names and accounts of the other party, read from narrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import register
from ..sources.ledger_view import LEGS_SQL, legs

#: How narrations show names and payment addresses.
UPI_NAME = r"(?i)UPI/\d+/(?:CR|DR)/([A-Za-z\s]{2,25})/"
BANK_NAME = r"(?i)(?:IMPS|NEFT|RTGS)[/\-](?:P2A|P2M)?[/\-]?\d+[/\-]([A-Za-z][A-Za-z\s]{2,30})"
ADDRESS = r"(?i)([A-Za-z0-9._\-]+@(?:oksbi|okhdfc|okaxis|okhdfcbank|ybl|axl|ibl|kotak|naviax|fbl|upi|paytm|mbk|cnrb|idfb|fdrl|bdbl|ratn|aubl|okicici|icicipay|sbi|hdfcbank|axisbank|[a-zA-Z0-9]+))"
CODE = r"^[A-Z0-9]{8,}$"
DIGITS = r"^\d+$"
ACCOUNT = r"^\d{10,18}$"
PARTS = r"[-/|]"
WORDS = r"(\p{L}+|\P{L}+)"


def title(text: Column) -> Column:
    """Each run of letters with a capital first and small ones after it."""
    runs = F.regexp_extract_all(text, F.lit(WORDS), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def party_name(narration: Column) -> Column:
    """A name after UPI, else after IMPS, NEFT or RTGS, else a payment address, else the first plausible part; '' if none or null."""
    text = F.trim(F.coalesce(narration, F.lit("")))
    upi, bank, address = (F.trim(F.regexp_extract(text, p, 1)) for p in (UPI_NAME, BANK_NAME, ADDRESS))
    parts = F.transform(F.slice(F.split(text, PARTS), 2, 3), lambda p: F.trim(p))
    plain = F.get(F.filter(parts, lambda p: ~p.rlike(CODE) & (F.length(p) > 2) & ~p.rlike(DIGITS)), 0)
    return F.when((F.length(upi) > 1) & ~upi.rlike(CODE), title(upi)).when(F.length(bank) > 2, title(bank)).when(address != "", address).otherwise(F.coalesce(title(plain), F.lit("")))


def party_account(narration: Column) -> Column:
    """A payment address in small letters, else the first part of 10 to 18 digits; '' if none or null."""
    text = F.coalesce(narration, F.lit(""))
    address = F.lower(F.regexp_extract(text, ADDRESS, 1))
    numbers = F.filter(F.transform(F.split(text, PARTS), lambda p: F.trim(p)), lambda p: p.rlike(ACCOUNT))
    return F.when(address != "", address).otherwise(F.coalesce(F.get(numbers, 0), F.lit("")))


#: The queries read the ledger's own narrations in the shapes that banks give them.
_NAME = "translate(cp, '0123456789', 'ABCDEFGHIJ')"
_SHAPES = f"""CASE CAST(rid % 6 AS INT) WHEN 0 THEN concat('UPI/', CAST(rid AS {{text}}), '/CR/', {_NAME}, '/SBI')
  WHEN 1 THEN concat('UPI/', CAST(rid AS {{text}}), '/DR/', substr({_NAME}, 5, 4), ' and sons/HDFC') WHEN 2 THEN concat('NEFT/', CAST(rid AS {{text}}), '-', {_NAME}, ' TRADERS')
  WHEN 3 THEN concat('PAY TO ', cp, '.x@okaxis / thanks') WHEN 4 THEN concat('BY CHQ|', CAST(rid % 10000000000 + 10000000000 AS {{text}}), '| rent of ', lower({_NAME}), '2nd') ELSE narration END"""
_SQL = f"WITH {LEGS_SQL}, x AS (SELECT leg_id, {_SHAPES.format(text='VARCHAR')} AS t FROM legs)"


def _title_sql(x: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({x}, '{WORDS}', 1), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')"


def _shown(s, d):
    return legs(s, d).select("leg_id", F.expr(_SHAPES.format(text="STRING")).alias("t"))


register(
    "fn_cp_name",
    lambda s, d: _shown(s, d).select("leg_id", party_name(F.col("t")).alias("cp_name")),
    f"""{_SQL}, y AS (SELECT leg_id, trim(regexp_extract(t, '{UPI_NAME}', 1)) AS u, trim(regexp_extract(t, '{BANK_NAME}', 1)) AS b, regexp_extract(t, '{ADDRESS}', 1) AS a,
  list_filter(list_transform(string_split_regex(t, '{PARTS}')[2:4], lambda p: trim(p)), lambda p: NOT regexp_matches(p, '{CODE}') AND length(p) > 2 AND NOT regexp_matches(p, '{DIGITS}'))[1] AS p FROM x)
SELECT leg_id, CASE WHEN length(u) > 1 AND NOT regexp_matches(u, '{CODE}') THEN {_title_sql('u')} WHEN length(b) > 2 THEN {_title_sql('b')} WHEN a <> '' THEN a WHEN p IS NOT NULL THEN {_title_sql('p')} ELSE '' END AS cp_name FROM y""",
)
register(
    "fn_cp_account",
    lambda s, d: _shown(s, d).select("leg_id", party_account(F.col("t")).alias("cp_account")),
    f"""{_SQL}, y AS (SELECT leg_id, lower(regexp_extract(t, '{ADDRESS}', 1)) AS a, list_filter(list_transform(string_split_regex(t, '{PARTS}'), lambda p: trim(p)), lambda p: regexp_matches(p, '{ACCOUNT}'))[1] AS n FROM x)
SELECT leg_id, CASE WHEN a <> '' THEN a ELSE coalesce(n, '') END AS cp_account FROM y""",
)
