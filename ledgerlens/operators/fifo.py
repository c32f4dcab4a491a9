"""First-in-first-out allocation of credits to debits without a loop.

Order each account's rows; let C and D be running credits and debits.  What an account has spent beyond its credits is
the running maximum L of D - C, or 0; the rest, F = D - L, is paid by credits in their order.  Credit i owns the
stretch from C before it to C, debit k that from F before it to F, and their overlap is the allocation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..sources.ledger_view import LEGS_SQL, legs

WIDE = "decimal(28,2)"


def fifo_stretches(ledger: DataFrame) -> DataFrame:
    """Adds what a row's credit or debit owns: [low, high), and the part of a debit that prior money pays."""
    order = Window.partitionBy("account_id").orderBy("ts", "leg_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.withColumns({"c": F.sum("credit").over(upto).cast(WIDE), "d": F.sum("debit").over(upto).cast(WIDE)})
    rows = rows.withColumn("l", F.greatest(F.max(F.col("d") - F.col("c")).over(upto), F.lit(0).cast(WIDE)))
    rows = rows.withColumn("f", F.col("d") - F.col("l"))
    return rows.withColumn("prior", F.col("l") - F.coalesce(F.lag("l").over(order), F.lit(0).cast(WIDE)))


def fifo_allocate(ledger: DataFrame) -> DataFrame:
    """(account_id, credit_id, debit_id, allocated); credit_id is null for money from before the first credit.

    Credits own stretches that follow each other, and so do debits.  The ends of both cut an account's money into pieces:
    each belongs to the credit and the debit that end next, at its upper end or above.  One pass from the highest end down
    sees these, so the work is linear in the account's rows, with nothing joined.  A row without an account, or without
    debit and credit, allocates nothing.
    """
    rows = fifo_stretches(ledger)
    ends = F.array(
        F.when(F.col("credit") > 0, F.struct(F.col("c").alias("at"), F.col("leg_id").alias("credit_id"), F.lit(None).cast("long").alias("debit_id"))),
        F.when(F.col("debit") > F.col("prior"), F.struct(F.col("f").alias("at"), F.lit(None).cast("long").alias("credit_id"), F.col("leg_id").alias("debit_id"))),
    )
    marks = rows.filter("account_id is not null").select("account_id", F.explode(F.array_compact(ends)).alias("mark")).select("account_id", "mark.*")
    down = Window.partitionBy("account_id").orderBy(F.desc("at"))
    seen = down.rowsBetween(Window.unboundedPreceding, 0)
    nearest = lambda c: F.last(c, ignorenulls=True).over(seen).alias(c)
    pieces = marks.select("account_id", nearest("credit_id"), nearest("debit_id"), (F.col("at") - F.coalesce(F.lead("at").over(down), F.lit(0).cast(WIDE))).cast(WIDE).alias("allocated"))
    paid = pieces.filter("allocated > 0 and debit_id is not null")
    prior = rows.filter("account_id is not null and prior > 0").select("account_id", F.lit(None).cast("long").alias("credit_id"), F.col("leg_id").alias("debit_id"), F.col("prior").cast(WIDE).alias("allocated"))
    return paid.unionByName(prior)


_FIFO_SQL = f"""WITH {LEGS_SQL},
cum AS (SELECT *, sum(credit) OVER w AS c, sum(debit) OVER w AS d FROM legs WINDOW w AS (PARTITION BY account_id ORDER BY ts, leg_id ROWS UNBOUNDED PRECEDING)),
owed AS (SELECT *, greatest(max(d - c) OVER (PARTITION BY account_id ORDER BY ts, leg_id ROWS UNBOUNDED PRECEDING), 0) AS l FROM cum),
x AS (SELECT *, d - l AS f, l - coalesce(lag(l) OVER (PARTITION BY account_id ORDER BY ts, leg_id), 0) AS prior FROM owed),
fifo AS (SELECT cr.account_id, cr.leg_id AS credit_id, db.leg_id AS debit_id, least(cr.c, db.f) - greatest(cr.c - cr.credit, db.f - (db.debit - db.prior)) AS allocated
  FROM x cr JOIN x db ON cr.account_id = db.account_id AND cr.credit > 0 AND db.debit > 0 AND least(cr.c, db.f) > greatest(cr.c - cr.credit, db.f - (db.debit - db.prior))
  UNION ALL SELECT account_id, NULL, leg_id, prior FROM x WHERE prior > 0)"""

register("wn_fifo", lambda s, d: fifo_allocate(legs(s, d)).select("account_id", F.coalesce("credit_id", F.lit(-1)).alias("credit_id"), "debit_id", F.col("allocated").cast("double").alias("allocated")), f"{_FIFO_SQL} SELECT account_id, coalesce(credit_id, -1) AS credit_id, debit_id, CAST(allocated AS DOUBLE) AS allocated FROM fifo")


def funded_by(ledger: DataFrame) -> DataFrame:
    """For each debit the number of credits that funded it, their share, and what came from before."""
    per = fifo_allocate(ledger).groupBy("account_id", "debit_id").agg(F.count("credit_id").alias("n_credits"), F.sum(F.when(F.col("credit_id").isNotNull(), F.col("allocated")).otherwise(0)).alias("funded"), F.sum(F.when(F.col("credit_id").isNull(), F.col("allocated")).otherwise(0)).alias("prior"))
    return per.select("account_id", "debit_id", "n_credits", F.col("funded").cast("double").alias("funded"), F.col("prior").cast("double").alias("prior"))


register(
    "tr_fifo_bwd",
    lambda s, d: funded_by(legs(s, d)),
    f"{_FIFO_SQL} SELECT account_id, debit_id, count(credit_id) AS n_credits, CAST(coalesce(sum(allocated) FILTER (credit_id IS NOT NULL), 0) AS DOUBLE) AS funded, CAST(coalesce(sum(allocated) FILTER (credit_id IS NULL), 0) AS DOUBLE) AS prior FROM fifo GROUP BY 1, 2",
)


def spent_on(ledger: DataFrame) -> DataFrame:
    """Each credit by itself consumes the account's later debits, in order, until it is used up or none is left.

    With d the running debits, a credit owns the stretch from d at its row on, as long as its amount.  The debits that
    begin in it are consecutive: the first has the next number, and the last is counted in the order of stretch ends and
    debit starts.  So a credit is joined to its own debits' numbers alone, however many the account has.
    """
    upto = Window.partitionBy("account_id").orderBy("ts", "leg_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.filter("credit > 0 or debit > 0").select("account_id", "leg_id", "credit", "debit", F.sum("debit").over(upto).cast(WIDE).alias("d"), F.count_if(F.col("debit") > 0).over(upto).alias("k"))
    ends = F.array(
        F.when(F.col("credit") > 0, F.struct((F.col("d") + F.col("credit")).cast(WIDE).alias("at"), F.lit(0).alias("begins"))),
        F.when(F.col("debit") > 0, F.struct((F.col("d") - F.col("debit")).cast(WIDE).alias("at"), F.lit(1).alias("begins"))),
    )
    marks = rows.withColumn("mark", F.explode(F.array_compact(ends))).select("account_id", "leg_id", "credit", "d", "k", "mark.*")
    # At equal amounts ends come first: a debit that begins where a credit ends gets nothing of it.
    begun = Window.partitionBy("account_id").orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, 0)
    credits = marks.withColumn("last", F.sum("begins").over(begun)).filter("begins = 0 and last > k")
    credits = credits.select("account_id", F.col("leg_id").alias("credit_id"), F.col("d").alias("low"), F.col("at").alias("high"), F.explode(F.sequence(F.col("k") + 1, F.col("last"))).alias("k"))
    debits = rows.filter("debit > 0").select("account_id", "k", F.col("leg_id").alias("debit_id"), (F.col("d") - F.col("debit")).cast(WIDE).alias("from"), F.col("d").alias("to"))
    return credits.join(debits, ["account_id", "k"]).select("account_id", "credit_id", "debit_id", (F.least("high", "to") - F.greatest("low", "from")).cast("double").alias("traced"))


register(
    "tr_fifo_fwd",
    lambda s, d: spent_on(legs(s, d)),
    f"""WITH {LEGS_SQL},
later AS (SELECT c.account_id, c.leg_id AS credit_id, c.credit, d.leg_id AS debit_id, d.debit, c.credit - (sum(d.debit) OVER (PARTITION BY c.leg_id ORDER BY d.ts, d.leg_id ROWS UNBOUNDED PRECEDING) - d.debit) AS left_
  FROM legs c JOIN legs d ON c.account_id = d.account_id AND c.credit > 0 AND d.debit > 0 AND (d.ts > c.ts OR (d.ts = c.ts AND d.leg_id > c.leg_id)))
SELECT account_id, credit_id, debit_id, CAST(least(left_, debit) AS DOUBLE) AS traced FROM later WHERE left_ > 0""",
)


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """Allocations with the dates, amounts and counterparties of both sides, and what was left of the credit after each."""
    info = ledger.select("leg_id", "date", "cp", "ts", F.greatest("debit", "credit").alias("amount"))
    a = fifo_allocate(ledger)
    credit = info.select(F.col("leg_id").alias("credit_id"), F.col("date").alias("credit_date"), F.col("amount").alias("credit_amount"), F.col("cp").alias("credit_source"))
    debit = info.select(F.col("leg_id").alias("debit_id"), F.col("date").alias("debit_date"), F.col("amount").alias("debit_amount"), F.col("cp").alias("debit_destination"), F.col("ts").alias("debit_ts"))
    rows = a.join(credit, "credit_id").join(debit, "debit_id")
    used = F.sum("allocated").over(Window.partitionBy("credit_id").orderBy("debit_ts", "debit_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("account_id", "credit_id", "debit_id", "credit_date", F.col("credit_amount").cast("double").alias("credit_amount"), "credit_source", "debit_date", F.col("debit_amount").cast("double").alias("debit_amount"), "debit_destination", F.col("allocated").cast("double").alias("allocation_amount"), (F.col("credit_amount") - used).cast("double").alias("remaining_credit"))


register(
    "tr_ledger",
    lambda s, d: ledger_rows(legs(s, d)),
    f"""{_FIFO_SQL} SELECT f.account_id, credit_id, debit_id, c.date AS credit_date, CAST(c.credit AS DOUBLE) AS credit_amount, c.cp AS credit_source, b.date AS debit_date, CAST(b.debit AS DOUBLE) AS debit_amount, b.cp AS debit_destination,
  CAST(allocated AS DOUBLE) AS allocation_amount, CAST(c.credit - sum(allocated) OVER (PARTITION BY credit_id ORDER BY b.ts, b.leg_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS remaining_credit
FROM fifo f JOIN legs c ON c.leg_id = credit_id JOIN legs b ON b.leg_id = debit_id""",
)
