"""Cleaning: parsing, normalising, flags, duplicates, imputation and quality scores.

The queries run on the ledger with its columns made messy by rules on the row's id, so every branch is met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import money, text
from ..sources.ledger_view import LEGS_SQL, bare_legs, dressed, legs

#: The same expressions make the rows messy here and in the oracle.
RAW = {
    "amount_raw": "CASE CAST(rid % 12 AS INT) WHEN 0 THEN concat('₹', m) WHEN 1 THEN concat('(', m, ')') WHEN 2 THEN concat(m, 'CR') WHEN 3 THEN concat(m, 'DR') WHEN 4 THEN concat('-', m) WHEN 5 THEN concat('Rs. ', m) "
    "WHEN 6 THEN concat(CAST(rid % 90 + 1 AS STRING), '.5 Lakh') WHEN 7 THEN concat(CAST(rid % 7 + 1 AS STRING), ' crore') WHEN 8 THEN 'Nil' WHEN 9 THEN '-' WHEN 10 THEN concat('1,', m) ELSE concat('DR ', m) END",
    "narration_raw": "CASE CAST(rid % 8 AS INT) WHEN 0 THEN concat('UPI/', CAST(rid % 100000 AS STRING), '/CR/Asha Rao/SBI') WHEN 1 THEN concat('IMPS-', CAST(rid % 100000 AS STRING), '-MOHAN LAL-SBIN0001234') WHEN 2 THEN 'ATM WDL  |~ FAILED' WHEN 3 THEN concat('neft to ', cp, ' payment declined') "
    "WHEN 4 THEN concat('salary credit ', CAST(rid % 31 AS STRING)) WHEN 5 THEN concat('pay ', lower(cp), '@okaxis') WHEN 6 THEN '' ELSE 'ok' END",
    "channel_raw": "CASE CAST(rid % 6 AS INT) WHEN 0 THEN ' upi/imps' WHEN 1 THEN 'NFT' WHEN 2 THEN 'atm wdl' WHEN 3 THEN 'CHQ ' WHEN 4 THEN channel ELSE 'gst' END",
    "account_raw": "CASE CAST(rid % 4 AS INT) WHEN 0 THEN concat(account_id, '(1)') WHEN 1 THEN concat(substr(account_id, 1, 4), ' ', substr(account_id, 5, 4)) WHEN 2 THEN concat(account_id, '_2_') ELSE account_id END",
    "ifsc_raw": "CASE CAST(rid % 3 AS INT) WHEN 0 THEN 'SBIN0001234' WHEN 1 THEN 'SBIN123' ELSE '' END",
    "debit_raw": "CASE WHEN rid % 17 = 0 THEN NULL ELSE debit END",
    "credit_raw": "CASE WHEN rid % 17 = 0 AND rid % 2 = 0 THEN NULL WHEN rid % 19 = 0 THEN debit ELSE credit END",
    "time_raw": "CASE WHEN rid % 23 = 0 THEN '' ELSE time END",
    "utr_raw": "CASE WHEN rid % 29 = 0 THEN '' ELSE utr_ref END",
}
_ALL = ", ".join(f"{v} AS {k}" for k, v in RAW.items())
RAW_SQL = f"{LEGS_SQL},\nraw AS (SELECT *, {_ALL} FROM (SELECT *, CAST(debit + credit AS STRING) AS m FROM legs) z)"


def raw(spark, sf_dir) -> DataFrame:
    rows = legs(spark, sf_dir).withColumn("m", (F.col("debit") + F.col("credit")).cast("string"))
    return rows.select("*", *(F.expr(v).alias(k) for k, v in RAW.items()))


def scalar(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], extra: str = "") -> None:
    """Columns are made when the query runs: importing needs no session."""
    register(name, lambda s, d: raw(s, d).select("leg_id", *(c.alias(k) for k, c in columns().items())), f"WITH {RAW_SQL}{extra} SELECT leg_id, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {'x' if extra else 'raw'}")


_X = r""",
a AS (SELECT *, trim(amount_raw) AS t FROM raw),
b AS (SELECT *, t LIKE '(%)' AS bracket, trim(regexp_replace(CASE WHEN t LIKE '(%)' THEN substr(t, 2, length(t) - 2) ELSE t END, '[₹$£€]|INR|Rs\.?|USD|GBP|EUR', '', 'gi')) AS s FROM a),
c AS (SELECT *, regexp_extract(s, '([\d,]+\.?\d*)\s*(lakh|lac|crore)\b', 1, 'i') AS num, lower(regexp_extract(s, '([\d,]+\.?\d*)\s*(lakh|lac|crore)\b', 2, 'i')) AS word, regexp_matches(s, '(cr|c)\s*$', 'i') AS ce, regexp_matches(s, '(dr|d)\s*$', 'i') AS de FROM b),
d AS (SELECT *, CASE WHEN ce THEN trim(regexp_replace(s, '(cr|c)\s*$', '', 'i')) WHEN de THEN trim(regexp_replace(s, '(dr|d)\s*$', '', 'i')) ELSE s END AS cut FROM c),
e AS (SELECT *, regexp_matches(cut, '^\s*(cr|c)\b', 'i') AS cs, regexp_matches(cut, '^\s*(dr|d)\b', 'i') AS ds, regexp_replace(replace(regexp_replace(cut, '^\s*(cr|c|dr|d)\b', '', 'i'), ',', ''), '[^\d.\-]', '', 'g') AS digits FROM d),
f AS (SELECT *, abs(coalesce(TRY_CAST(CASE WHEN length(digits) - length(replace(digits, '.', '')) > 1 THEN split_part(digits, '.', 1) || '.' || replace(substr(digits, strpos(digits, '.') + 1), '.', '') ELSE digits END AS DOUBLE), 0)) AS plain FROM e),
x AS (SELECT *, CASE WHEN num <> '' THEN CAST(replace(num, ',', '') AS DOUBLE) * CASE WHEN word = 'crore' THEN 10000000.0 ELSE 100000.0 END ELSE plain END AS value,
  (bracket OR regexp_matches(s, '^\s*-') OR (num = '' AND ((NOT ce AND de) OR (NOT cs AND ds)))) AS minus FROM f)"""
register(
    "fn_parse_amount_clean",
    lambda s, d: money.with_amount(raw(s, d), "amount_raw", "amount").select("leg_id", "amount"),
    f"WITH {RAW_SQL}{_X} SELECT leg_id, CASE WHEN lower(t) IN ('', '-', '--', 'nil', 'n/a', 'nan', 'none') THEN 0.0 WHEN minus AND value <> 0 THEN -value ELSE value END AS amount FROM x",
)
_Y = r""",
a AS (SELECT *, trim(amount_raw) AS t, lower(regexp_extract(trim(amount_raw), '^\s*(cr|dr)\b\.?\s*', 1, 'i')) AS first, trim(regexp_replace(trim(amount_raw), '^\s*(cr|dr)\b\.?\s*', '', 'i')) AS s0 FROM raw),
b AS (SELECT *, s0 LIKE '-%' AS minus, CASE WHEN s0 LIKE '-%' THEN substr(s0, 2) ELSE s0 END AS s1 FROM a),
c AS (SELECT *, s1 LIKE '(%)' AS bracket, CASE WHEN s1 LIKE '(%)' THEN substr(s1, 2, length(s1) - 2) ELSE s1 END AS s2 FROM b),
x AS (SELECT *, lower(regexp_extract(s2, '(cr|dr)\s*$', 1, 'i')) AS last, t IN ('', '-', '--', 'nil', 'n/a', 'nan') AS blank, abs(coalesce(TRY_CAST(regexp_replace(regexp_replace(s2, '[₹$£€]|INR|Rs\.?', '', 'gi'), '[^\d.]', '', 'g') AS DOUBLE), 0)) AS v FROM c)"""
scalar("fn_parse_amount_ingest", lambda: {x: money.parse_unsigned(F.col("amount_raw"))[x] for x in ("amount", "sign")}, {"amount": "CASE WHEN blank THEN 0.0 ELSE v END", "sign": "CASE WHEN blank THEN '' WHEN first = 'cr' THEN '+' WHEN first = 'dr' OR minus OR bracket THEN '-' WHEN last = 'cr' THEN '+' WHEN last = 'dr' THEN '-' ELSE '' END"}, _Y)
scalar("fn_clean_money", lambda: {"amount": F.coalesce(F.regexp_replace(F.regexp_replace("amount_raw", "[₹, ]", ""), r"[^\d.\-]", "").try_cast("double"), F.lit(0.0))}, {"amount": r"coalesce(TRY_CAST(regexp_replace(regexp_replace(amount_raw, '[₹, ]', '', 'g'), '[^\d.\-]', '', 'g') AS DOUBLE), 0.0)"})
scalar("fn_norm_narration", lambda: {"narration": text.normal_narration(F.col("narration_raw"))}, {"narration": r"upper(trim(regexp_replace(regexp_replace(regexp_replace(narration_raw, '[/\-]', ' ', 'g'), '[|\\<>{}\[\]~`°]', ' ', 'g'), '\s+', ' ', 'g')))"})
scalar("fn_norm_account", lambda: {"account": text.normal_account(F.col("account_raw"))}, {"account": r"regexp_replace(regexp_replace(account_raw, '[(_]+\d+[)_]+$', ''), '\s+', '', 'g')"})
_names = ", ".join(f"'{k}': '{v}'" for k, v in text.CHANNEL_NAMES.items())
scalar("fn_norm_channel", lambda: {"channel": text.normal_channel(F.col("channel_raw"))}, {"channel": f"coalesce(MAP {{{_names}}}[upper(trim(channel_raw))], upper(trim(channel_raw)))"})
_infer = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(narration_raw), {w!r})' for w in words)} THEN '{name}'" for name, words in text.CHANNEL_WORDS) + " ELSE 'OTHER' END"
scalar("fn_infer_channel", lambda: {"channel": text.infer_channel(F.col("narration_raw"))}, {"channel": _infer})
_words = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
scalar("fn_tokenize", lambda: {"tokens": F.array_join(text.tokens(F.col("narration_raw")), ",")}, {"tokens": rf"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(narration_raw), '\b([a-z0-9]{{3,}})\b', 1), lambda w: w NOT IN ({_words})))), ',')"})
scalar("fn_cp_ifsc", lambda: {"ifsc": F.regexp_extract("narration_raw", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", 1), "valid": F.col("ifsc_raw").rlike("^[A-Z]{4}0[A-Z0-9]{6}$")}, {"ifsc": r"regexp_extract(narration_raw, '\b([A-Z]{4}0[A-Z0-9]{6})\b', 1)", "valid": "regexp_matches(ifsc_raw, '^[A-Z]{4}0[A-Z0-9]{6}$')"})
_no_names = ", ".join(f"'{w}'" for w in text.NO_NAMES)
scalar(
    "fn_pseudo_cp",
    lambda: {"party": text.pseudo_party(F.col("narration_raw"))},
    {"party": f"CASE WHEN t = '' THEN 'UNKNOWN' ELSE coalesce(list_filter(parts[2:1000], lambda p: p NOT IN ({_no_names}) AND regexp_full_match(p, '[A-Z .]{{3,40}}'))[1], nullif(substr(CASE WHEN len(parts) > 2 THEN array_to_string(parts[3:1000], '-') ELSE t END, 1, 30), ''), 'UNKNOWN') END"},
    ", x AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[-/]'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM (SELECT *, upper(trim(narration_raw)) AS t FROM raw) q)",
)
_merchant = " OR ".join(f"contains(upper(trim(narration_raw)), '{w}')" for w in text.MERCHANTS + text.UTILITIES)
scalar("fn_is_merchant", lambda: {"merchant": text.is_merchant(F.col("narration_raw"))}, {"merchant": f"trim(narration_raw) IN ('', 'NAN', 'NONE') OR {_merchant}"})
_day = "CASE CAST(rid % 5 AS INT) WHEN 0 THEN concat(substr(date, 9, 2), '/', substr(date, 6, 2), '/', substr(date, 1, 4)) WHEN 1 THEN concat(substr(date, 9, 2), '-', substr(date, 6, 2), '-', substr(date, 3, 2)) WHEN 2 THEN date WHEN 3 THEN concat(' ', date, ' ') ELSE concat('1999', substr(date, 5)) END"
register(
    "fn_parse_date_clean",
    lambda s, d: raw(s, d).select("leg_id", F.coalesce(text.parse_date(F.expr(_day)), F.lit("")).alias("iso")),
    f"WITH {RAW_SQL} SELECT leg_id, CASE WHEN rid % 5 = 4 THEN '' ELSE date END AS iso FROM raw",
)
scalar("fn_hour", lambda: {"hour": F.coalesce(F.split("time_raw", ":")[0].try_cast("int"), F.lit(12))}, {"hour": "coalesce(TRY_CAST(split_part(time_raw, ':', 1) AS INT), 12)"})


def temporal() -> dict[str, Column]:
    h, w = F.hour("ts"), F.weekday("ts")
    return {"hour": h, "dow": w, "dom": F.dayofmonth("ts"), "month": F.month("ts"), "weekend": w >= 5, "night": (h >= 22) | (h <= 5), "odd": (h >= 23) | (h <= 4), "hour_sin": F.round(F.sin(h * 2 * F.pi() / 24), 6) + 0.0, "dow_cos": F.round(F.cos(w * 2 * F.pi() / 7), 6)}


scalar(
    "fn_temporal",
    temporal,
    {"hour": "CAST(hour(ts) AS INT)", "dow": "CAST(isodow(ts) - 1 AS INT)", "dom": "CAST(day(ts) AS INT)", "month": "CAST(month(ts) AS INT)", "weekend": "isodow(ts) >= 6", "night": "hour(ts) >= 22 OR hour(ts) <= 5", "odd": "hour(ts) >= 23 OR hour(ts) <= 4", "hour_sin": "round(sin(hour(ts) * 2 * pi() / 24), 6)", "dow_cos": "round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6)"},
)
_EDGES = [1000, 5000, 10000, 50000, 100000, 500000]
_NEAR = [(9000, 10000), (49000, 50000), (99000, 100000), (199000, 200000)]


def amount() -> Column:
    return F.col("debit") + F.col("credit")


def bucket() -> Column:
    case = F.when(amount() <= _EDGES[0], 0)
    for k, edge in enumerate(_EDGES[1:], 1):
        case = case.when(amount() <= edge, k)
    return case.otherwise(6)


def near_threshold() -> Column:
    hit = F.lit(False)
    for low, high in _NEAR:
        hit = hit | ((amount() >= low) & (amount() < high))
    return hit


scalar("fn_bucket", lambda: {"bucket": bucket()}, {"bucket": "CASE " + " ".join(f"WHEN debit + credit <= {e} THEN {k}" for k, e in enumerate(_EDGES)) + " ELSE 6 END"})
scalar(
    "fn_structuring",
    lambda: {"near_threshold": near_threshold(), **{f"round_{k}": amount() % k == 0 for k in (1000, 5000, 10000)}},
    {"near_threshold": " OR ".join(f"(debit + credit >= {a} AND debit + credit < {b})" for a, b in _NEAR), **{f"round_{k}": f"(debit + credit) % {k} = 0" for k in (1000, 5000, 10000)}},
)
_groups = {"is_transfer": "TRANSFER|NEFT|RTGS|IMPS|TRF", "is_cash": "CASH|ATM|WITHDRAW|WDL", "is_salary": "SALARY|SAL|PAYROLL", "is_upi": "UPI|PHONEPE|GPAY|PAYTM|BHIM"}
scalar("fn_narr_flags", lambda: {k: F.upper("narration_raw").rlike(v) for k, v in _groups.items()}, {k: f"regexp_matches(upper(narration_raw), '{v}')" for k, v in _groups.items()})
scalar("fn_channel_enc", lambda: {"code": F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in text.CHANNEL_CODES.items() for x in kv]), F.upper(F.trim("channel"))), F.lit(0))}, {"code": "CASE channel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.CHANNEL_CODES.items()) + " ELSE 0 END"})

# ------------------------------------------------------------------------------------------------ flags
def flags() -> dict[str, Column]:
    d, c = F.coalesce("debit_raw", F.lit(0)), F.coalesce("credit_raw", F.lit(0))
    return {
        "MISSING_AMOUNT_FILLED": F.col("debit_raw").isNull() != F.col("credit_raw").isNull(),
        "BOTH_AMOUNTS_MISSING": F.col("debit_raw").isNull() & F.col("credit_raw").isNull(),
        "INVALID_TRANSACTION": (d > 0) & (c > 0),
        "ZERO_DEBIT_AND_CREDIT": (d == 0) & (c == 0),
        "MISSING_NARRATION_FILLED": F.trim("narration_raw") == "",
        "EMPTY_OR_SHORT_NARRATION": F.length(F.trim("narration_raw")) < 3,
        "MISSING_UTR": F.trim("utr_raw") == "",
        "MISSING_TIME_DEFAULTED": F.trim("time_raw") == "",
        "MALFORMED_IFSC": (F.col("ifsc_raw") != "") & ~F.col("ifsc_raw").rlike("^[A-Z]{4}0[A-Z0-9]{6}$"),
        "SELF_TRANSFER": F.col("cp") == F.col("account_id"),
    }


_FLAGS_SQL = {
    "MISSING_AMOUNT_FILLED": "(debit_raw IS NULL) <> (credit_raw IS NULL)",
    "BOTH_AMOUNTS_MISSING": "debit_raw IS NULL AND credit_raw IS NULL",
    "INVALID_TRANSACTION": "coalesce(debit_raw, 0) > 0 AND coalesce(credit_raw, 0) > 0",
    "ZERO_DEBIT_AND_CREDIT": "coalesce(debit_raw, 0) = 0 AND coalesce(credit_raw, 0) = 0",
    "MISSING_NARRATION_FILLED": "trim(narration_raw) = ''",
    "EMPTY_OR_SHORT_NARRATION": "length(trim(narration_raw)) < 3",
    "MISSING_UTR": "trim(utr_raw) = ''",
    "MISSING_TIME_DEFAULTED": "trim(time_raw) = ''",
}
#: What each flag takes off a score of 100.
PENALTIES = {"INVALID_TRANSACTION": 15, "ZERO_DEBIT_AND_CREDIT": 10, "MISSING_NARRATION_FILLED": 5, "MISSING_AMOUNT_FILLED": 10, "BOTH_AMOUNTS_MISSING": 20, "MISSING_UTR": 3, "MISSING_TIME_DEFAULTED": 2, "EMPTY_OR_SHORT_NARRATION": 10, "MALFORMED_IFSC": 10, "SELF_TRANSFER": 5}


def clean_flags(rows: DataFrame) -> DataFrame:
    """Adds clean_flags, an array of the flags that hold, in a fixed order."""
    return rows.withColumn("clean_flags", F.array_compact(F.array(*(F.when(hit, name) for name, hit in flags().items()))))


_ALL_FLAGS_SQL = {**_FLAGS_SQL, "MALFORMED_IFSC": "ifsc_raw <> '' AND NOT regexp_matches(ifsc_raw, '^[A-Z]{4}0[A-Z0-9]{6}$')", "SELF_TRANSFER": "cp = account_id"}
_FLAG_LIST_SQL = "list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _ALL_FLAGS_SQL.items()) + "], lambda f: f IS NOT NULL)"
_SCORE_SQL = "greatest(0, 100 - (" + " + ".join(f"CASE WHEN {_ALL_FLAGS_SQL[k]} THEN {p} ELSE 0 END" for k, p in PENALTIES.items()) + "))"

register("im_missing", lambda s, d: clean_flags(raw(s, d)).select("leg_id", F.coalesce("debit_raw", F.lit(0)).cast("double").alias("debit"), F.when(F.trim("time_raw") == "", "00:00:00").otherwise(F.col("time_raw")).alias("time"), F.array_join("clean_flags", " | ").alias("clean_flags")), f"WITH {RAW_SQL} SELECT leg_id, CAST(coalesce(debit_raw, 0) AS DOUBLE) AS debit, CASE WHEN trim(time_raw) = '' THEN '00:00:00' ELSE time_raw END AS time, array_to_string({_FLAG_LIST_SQL}, ' | ') AS clean_flags FROM raw")


def quality(rows: DataFrame) -> DataFrame:
    """Adds quality_score and quality_band from the flags."""
    cost = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    score = F.greatest(F.lit(0), F.aggregate("clean_flags", F.lit(100), lambda a, f: a - F.coalesce(F.try_element_at(cost, f), F.lit(0))))
    return rows.withColumn("quality_score", score).withColumn("quality_band", F.when(F.col("quality_score") >= 80, "HIGH").when(F.col("quality_score") >= 50, "MEDIUM").otherwise("LOW"))


_BAND_SQL = "CASE WHEN quality_score >= 80 THEN 'HIGH' WHEN quality_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END"
register("ag_quality", lambda s, d: quality(clean_flags(raw(s, d))).select("leg_id", "quality_score", "quality_band"), f"WITH {RAW_SQL}, q AS (SELECT leg_id, {_SCORE_SQL} AS quality_score FROM raw) SELECT *, {_BAND_SQL} AS quality_band FROM q")
register("ag_quality_bands", lambda s, d: quality(clean_flags(raw(s, d))).groupBy("quality_band").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 9).alias("avg_score")), f"WITH {RAW_SQL}, q AS (SELECT leg_id, {_SCORE_SQL} AS quality_score FROM raw) SELECT {_BAND_SQL} AS quality_band, count(*) AS n, round(avg(quality_score), 9) AS avg_score FROM q GROUP BY 1")
register("im_actions", lambda s, d: clean_flags(raw(s, d)).select("leg_id", "account_id", F.explode("clean_flags").alias("action_type")), f"WITH {RAW_SQL} SELECT leg_id, account_id, unnest({_FLAG_LIST_SQL}) AS action_type FROM raw")
register("flt_any_flag", lambda s, d: clean_flags(raw(s, d)).filter(F.size("clean_flags") > 0).select("leg_id", F.size("clean_flags").cast("long").alias("n_flags")), f"WITH {RAW_SQL}, q AS (SELECT leg_id, len({_FLAG_LIST_SQL}) AS n_flags FROM raw) SELECT * FROM q WHERE n_flags > 0")
for _name, _flag in (("flt_invalid_txn", "INVALID_TRANSACTION"), ("flt_zero", "ZERO_DEBIT_AND_CREDIT"), ("flt_short_narr", "EMPTY_OR_SHORT_NARRATION"), ("flt_bad_ifsc", "MALFORMED_IFSC")):
    register(_name, lambda s, d, f=_flag: clean_flags(raw(s, d)).filter(F.array_contains("clean_flags", f)).select("leg_id", "account_id"), f"WITH {RAW_SQL} SELECT leg_id, account_id FROM raw WHERE {_ALL_FLAGS_SQL[_flag]}")


def failed() -> Column:
    return F.array_compact(F.array(*(F.when(F.upper("narration_raw").rlike(rf"\b{w}\b"), f"FAILED_{w}") for w in text.FAILED_WORDS)))


register("flt_failed", lambda s, d: raw(s, d).select("leg_id", F.explode(failed()).alias("flag")), f"WITH {RAW_SQL} " + " UNION ALL ".join(rf"SELECT leg_id, 'FAILED_{w}' AS flag FROM raw WHERE regexp_matches(upper(narration_raw), '\b{w}\b')" for w in text.FAILED_WORDS))

# ------------------------------------------------------------------------------------------------ duplicates
_COPIES_SQL = """,
doubled AS (SELECT row_number() OVER (PARTITION BY account_id ORDER BY ts, leg_id, copy) AS pos, * FROM (
  SELECT *, 0 AS copy FROM legs UNION ALL SELECT * REPLACE (CASE WHEN rid % 2 = 0 THEN source_file ELSE 'F9' END AS source_file), 1 AS copy FROM legs WHERE rid % 13 = 0 UNION ALL SELECT * REPLACE ('F8' AS source_file), 2 AS copy FROM legs WHERE rid % 39 = 0) z)"""


def copied(spark, sf_dir) -> DataFrame:
    """Bare legs, some two or three times (copy 0, 1, 2), with each row's place in its account."""
    rows = bare_legs(spark, sf_dir)
    every = rows.withColumn("copy", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("rid") % 13 == 0, 1), F.when(F.col("rid") % 39 == 0, 2)))))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("account_id").orderBy("ts", "leg_id", "copy")))


def as_copies(rows: DataFrame) -> DataFrame:
    """copied() with texts; copies come from other files."""
    dressed_ = dressed(rows)
    file = F.when(F.col("copy") == 2, "F8").when((F.col("copy") == 1) & (F.col("rid") % 2 != 0), "F9").otherwise(F.col("source_file"))
    return dressed_.withColumn("source_file", file).select(*(c for c in dressed_.columns if c not in ("copy", "pos")), "copy", "pos")


def doubled(spark, sf_dir) -> DataFrame:
    """The ledger with some rows two or three times, and each row's place in its account."""
    return as_copies(copied(spark, sf_dir))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Rows equal to one before: dropped if near to it in one file or from two files only, else flagged as a collision."""
    keys = ["account_id", "date", "narration", "debit", "credit", "utr_ref"]
    group = Window.partitionBy(*keys)
    order = group.orderBy("pos")
    near = (F.col("source_file") == F.lag("source_file").over(order)) & (F.col("pos") - F.lag("pos").over(order) <= 10)
    same = F.col("source_file") == F.lag("source_file").over(order)
    two_files = F.size(F.collect_set("source_file").over(group)) == 2
    action = F.when(F.lag("pos").over(order).isNull(), None).when(near, "DROP").when(same, None).when(two_files, "DROP").otherwise("COLLISION")
    return rows.withColumn("action", action).filter("action is not null")


register(
    "st_exact_dup",
    lambda s, d: exact_duplicates(doubled(s, d)).select("leg_id", "copy", "action"),
    f"""WITH {LEGS_SQL}{_COPIES_SQL},
g AS (SELECT *, lag(source_file) OVER w AS pf, lag(pos) OVER w AS pp, count(DISTINCT source_file) OVER (PARTITION BY account_id, date, narration, debit, credit, utr_ref) AS files FROM doubled WINDOW w AS (PARTITION BY account_id, date, narration, debit, credit, utr_ref ORDER BY pos))
SELECT * FROM (SELECT leg_id, copy, CASE WHEN pp IS NULL THEN NULL WHEN source_file = pf AND pos - pp <= 10 THEN 'DROP' WHEN source_file = pf THEN NULL WHEN files = 2 THEN 'DROP' ELSE 'COLLISION' END AS action FROM g) WHERE action IS NOT NULL""",
)


def utr_collisions(rows: DataFrame) -> DataFrame:
    """Electronic rows that share a reference, but for the two legs of one transfer."""
    electronic = rows.filter((F.col("utr_ref") != "") & F.col("channel").isin("UPI", "IMPS", "NEFT", "RTGS", "WIRE"))
    per = electronic.groupBy("utr_ref").agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("accounts"), F.abs(F.sum("debit") - F.sum("credit")).alias("off"))
    bad = per.filter((F.col("n") >= 2) & ~((F.col("n") == 2) & (F.col("accounts") == 2) & (F.col("off") < 0.01)))
    return electronic.join(bad.select("utr_ref"), "utr_ref", "left_semi")


register(
    "st_utr",
    lambda s, d: utr_collisions(doubled(s, d)).select("leg_id", "copy", "utr_ref"),
    f"""WITH {LEGS_SQL}{_COPIES_SQL}, el AS MATERIALIZED (SELECT * FROM doubled WHERE channel IN ('UPI', 'IMPS', 'NEFT', 'RTGS', 'WIRE')),
bad AS MATERIALIZED (SELECT utr_ref FROM el GROUP BY 1 HAVING count(*) >= 2 AND NOT (count(*) = 2 AND count(DISTINCT account_id) = 2 AND abs(sum(debit) - sum(credit)) < 0.01))
SELECT leg_id, copy, utr_ref FROM el WHERE utr_ref IN (SELECT utr_ref FROM bad)""",
)
register(
    "st_aml_dup",
    lambda s, d: doubled(s, d).withColumn("k", F.row_number().over(Window.partitionBy("account_id", "date", "time", "debit", "credit").orderBy("pos"))).filter("k = 1").select("leg_id", "copy"),
    f"WITH {LEGS_SQL}{_COPIES_SQL} SELECT leg_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY account_id, date, time, debit, credit ORDER BY pos) AS k FROM doubled) WHERE k = 1",
)
register(
    "ag_dup_rates",
    lambda s, d: exact_duplicates(doubled(s, d)).groupBy("action").agg(F.count("*").alias("n")),
    f"""WITH {LEGS_SQL}{_COPIES_SQL},
g AS (SELECT *, lag(source_file) OVER w AS pf, lag(pos) OVER w AS pp, count(DISTINCT source_file) OVER (PARTITION BY account_id, date, narration, debit, credit, utr_ref) AS files FROM doubled WINDOW w AS (PARTITION BY account_id, date, narration, debit, credit, utr_ref ORDER BY pos))
SELECT action, count(*) AS n FROM (SELECT CASE WHEN pp IS NULL THEN NULL WHEN source_file = pf AND pos - pp <= 10 THEN 'DROP' WHEN source_file = pf THEN NULL WHEN files = 2 THEN 'DROP' ELSE 'COLLISION' END AS action FROM g) WHERE action IS NOT NULL GROUP BY 1""",
)
