"""Narrations, channels, parties and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of channels.
CHANNEL_NAMES = {
    "UPI/IMPS": "UPI", "UPI-IMPS": "UPI", "IMPS/UPI": "IMPS", "NEFT/RTGS": "NEFT", "NFT": "NEFT", "ATM WDL": "ATM", "ATM-WDL": "ATM", "NFS CASH": "ATM", "NACH": "ECS",
    "SI": "ECS", "CHQ": "CHEQUE", "CLG": "CHEQUE", "BB/CHQ": "CHEQUE", "SWIFT": "WIRE", "NOSTRO": "WIRE", "EMI": "LOAN", "SBINT": "INTEREST", "GST": "CHARGES",
}
#: Words that name a channel, in the order of looking.
CHANNEL_WORDS = [
    ("UPI", ["upi", "gpay", "phonepe", "paytm", "bhim", "googlepay", "@okhdfcbank", "@oksbi", "@ybl", "@axl", "@okaxis", "@ibl", "@kotak", "@okicici"]),
    ("NEFT", ["neft", "nft/", "inft"]),
    ("IMPS", ["imps"]),
    ("RTGS", ["rtgs", "blkrtgs"]),
    ("ATM", ["atm", "cash withdrawal", "atm wdl", "cwdl", "nfs cash"]),
    ("ECS", ["ecs", "nach", "si-", "standing instruction", "auto debit"]),
    ("CHEQUE", ["clg", "clearing", "chq", "cheque", "chq dep", "bb/chq", "cheque deposit"]),
    ("BILLPAY", ["billdesk", "billpay", "bbps", "electricity", "utility", "broadband", "recharge"]),
    ("CASH", ["cash dep", "cash deposit", "counter deposit", "cash credit", "by cash", "branch cash"]),
    ("WIRE", ["swift", "wire transfer", "foreign", "remittance", "international", "nostro"]),
    ("LOAN", ["loan disbursement", "emi", "loan emi", "housing loan", "vehicle loan", "personal loan"]),
    ("INTEREST", ["interest credit", "int credit", "sbint", "interest", "int on", "tds on int"]),
    ("CHARGES", ["charges", "service charge", "gst", "maintenance", "fee", "penalty", "fine"]),
    ("REVERSAL", ["reversal", "reverse", "refund", "cashback", "chargeback"]),
]
#: Fixed values.
CHANNEL_CODES = {"NEFT": 1, "RTGS": 2, "IMPS": 3, "UPI": 4, "ATM": 5, "POS": 6, "ONLINE": 7, "CASH": 8, "CHARGES": 9, "CHEQUE": 10}
FAILED_WORDS = ["FAILED", "DECLINED", "TIMEOUT", "REVERSED", "CANCELLED", "ROLLBACK"]
STOP_WORDS = ["neft", "upi", "imps", "rtgs", "transfer", "to", "from", "by", "for", "in", "of", "and", "the", "a", "an", "on", "at", "with", "payment", "txn", "tx", "trans", "cr", "dr", "val", "ref", "utr", "no", "id", "self", "amount", "rupees", "rs", "inr"]
NO_NAMES = ["CR", "DR", "IMPS", "UPI", "UPIAR", "UPIAB", "UPIAC", "UPICR", "UPIDR", "NEFT", "RTGS", "TRANSFER", "PAYMENT", "ANN", "FEE", "INT", "PD", "CHARGES", "SC", "GST", "FT", "OTHER", "CHEQUE", "SMS", "QTR"]
MERCHANTS = ["AMAZON", "SWIGGY", "IRCTC", "FLIPKART", "ZOMATO", "UBER", "OLA", "ZEPTO", "BLINKIT", "PAYTM", "PHONEPE", "GPAY", "GOOGLE PAY", "BHIM", "CRED", "RAZORPAY", "CASHFREE", "PAYU", "BILLDESK", "PAYU@HDFCBANK", "BDPG@HDFCBANK", "JIO", "AIRTEL", "NETFLIX", "SPOTIFY", "TATACLIQ"]
UTILITIES = ["HEAD OFFICE", "SELF", "CASH", "ATM", "25 NFS", "OPW", "MOB", "NEFT", "IMPS", "UPI", "RTGS", "UNKNOWN", "FEE", "CHARGE", "INTEREST", "DECLINE", "MINIMUM BALANCE", "SMS"]

DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd-MM-yy", "dd-MMM-yyyy", "dd-MMM-yy", "dd MMM yyyy", "dd MMMM yyyy", "MM/dd/yyyy"]


def _any(words: list[str]) -> str:
    return "|".join(w.replace("/", "\\/").replace(".", "\\.") for w in words)


def normal_narration(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[/\-]", " "), r"[|\\<>{}\[\]~`°]", " ")
    return F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))


def normal_account(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[(_]+\d+[)_]+$", ""), r"\s+", "")


def normal_channel(text: Column) -> Column:
    s = F.upper(F.trim(text))
    names = F.create_map(*[F.lit(x) for kv in CHANNEL_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, s), s)


def infer_channel(narration: Column) -> Column:
    s, case = F.lower(F.coalesce(narration, F.lit(""))), None
    for name, words in CHANNEL_WORDS:
        hit = s.rlike(_any(words))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("OTHER")


def is_merchant(party: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(party, F.lit(""))))
    return s.isin("", "NAN", "NONE") | s.rlike(_any(MERCHANTS + UTILITIES))


def tokens(narration: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(narration, F.lit(""))), F.lit(r"\b([a-z0-9]{3,})\b"), 1)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))))


def pseudo_party(narration: Column) -> Column:
    """A name from a narration: the first part after the first that looks like one, else up to 30 characters of the rest."""
    text = F.upper(F.trim(F.coalesce(narration, F.lit(""))))
    parts = F.filter(F.transform(F.split(text, "[-/]"), lambda p: F.trim(p)), lambda p: p != "")
    names = F.filter(F.slice(parts, 2, 1000), lambda p: ~p.isin(NO_NAMES) & p.rlike(r"^[A-Z .]{3,40}$"))
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, 1000), "-")).otherwise(text)
    return F.when(text == "", "UNKNOWN").otherwise(F.coalesce(F.get(names, 0), F.nullif(F.substring(rest, 1, 30), F.lit("")), F.lit("UNKNOWN")))


def parse_date(raw: Column) -> Column:
    """An ISO date from the accepted formats, in their order; null where none fits or the year is not from 2000 to 2035."""
    shapes = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yy": r"^\d{2}/\d{2}/\d{2}$", "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yy": r"^\d{2}-\d{2}-\d{2}$", "dd-MMM-yyyy": r"^\d{2}-[A-Za-z]{3}-\d{4}$", "dd-MMM-yy": r"^\d{2}-[A-Za-z]{3}-\d{2}$", "dd MMM yyyy": r"^\d{2} [A-Za-z]{3} \d{4}$", "dd MMMM yyyy": r"^\d{2} [A-Za-z]{4,} \d{4}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$"}
    s = F.trim(raw)
    got = F.coalesce(*(F.when(s.rlike(shapes[f]), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for f in DATE_FORMATS))
    return F.when(F.year(got).between(2000, 2035), F.date_format(got, "yyyy-MM-dd"))
