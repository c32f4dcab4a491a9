"""The order of one day's rows, told from their balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import checkpointed, fixpoint
from ..sources.ledger_view import BALANCED_SQL, balanced_legs


def day_links(ledger: DataFrame) -> DataFrame:
    """(id, before): a row and the row of its account and day that it follows, null where none.

    A row follows one whose balance is its own balance less its amount.  Where several rows have that balance, or
    several rows ask for it, the k-th in file order follows the k-th, so each row is followed once at most.
    """
    prior = (F.col("balance") - F.col("credit") + F.col("debit")).cast("decimal(28,2)")
    rows = ledger.select("leg_id", "account_id", "date", F.col("balance").cast("decimal(28,2)").alias("balance"), prior.alias("prior"))
    numbered = lambda c: F.row_number().over(Window.partitionBy("account_id", "date", c).orderBy("leg_id"))
    asks = rows.filter("prior is not null").select(F.col("leg_id").alias("id"), "account_id", "date", F.col("prior").alias("value"), numbered("prior").alias("k"))
    gives = rows.filter("balance is not null").select(F.col("leg_id").alias("before"), "account_id", "date", F.col("balance").alias("value"), numbered("balance").alias("k"))
    linked = asks.join(gives, ["account_id", "date", "value", "k"]).filter("id <> before").select("id", "before")
    return rows.select(F.col("leg_id").alias("id")).join(linked, "id", "left")


def _ranked(links: DataFrame) -> DataFrame:
    """(id, head, steps, least, at) of linked rows by doubling: `at` is null where a head was found, else the row is on a ring, whose smallest id is `least`.

    Every round asks the row that a row has come to how far that one came; rings stop changing in nothing but `at` once
    the steps exceed all rows of the longest day, which is when the search ends.
    """
    longest = links.filter("before is not null").groupBy("account_id", "date").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    start = links.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("steps"), F.col("id").alias("least"), F.col("before").alias("at")).withColumn("changed", F.col("at").isNotNull())

    def step(state: DataFrame) -> DataFrame:
        ahead = state.select(F.col("id").alias("at"), F.col("head").alias("far_head"), F.col("steps").alias("far_steps"), F.col("least").alias("far_least"), F.col("at").alias("far_at"))
        both = state.join(ahead, "at", "left")
        went = F.col("at").isNotNull()
        steps = F.when(went, F.col("steps") + F.col("far_steps") + 1).otherwise(F.col("steps"))
        rows = both.select("id", F.when(went, F.col("far_head")).otherwise(F.col("head")).alias("head"), steps.alias("steps"), F.least("least", F.coalesce("far_least", "least")).alias("least"), F.when(went, F.col("far_at")).alias("at"))
        return rows.withColumn("changed", F.col("at").isNotNull() & (F.col("steps") <= longest))

    return fixpoint(start, step, "changed")


def same_day_order(ledger: DataFrame) -> DataFrame:
    """(leg_id, seq): the place of each row among its account's rows of its day, from 0, so that balances chain.

    Rows follow each other as day_links says; chains stand in the order of their first rows, which is file order, and a
    ring of balances begins at its first row in file order.  Rows without a balance stand alone.  File order is the
    order of leg_id.
    """
    days = ledger.select(F.col("leg_id").alias("id"), "account_id", "date")
    links = checkpointed(day_links(ledger).join(days, "id"))
    found = checkpointed(_ranked(links))
    rings = found.filter("at is not null").select("id", F.col("least").alias("first"))
    cut = links.join(rings, "id").select("id", "account_id", "date", F.when(F.col("id") != F.col("first"), F.col("before")).alias("before"))
    ranked = found.filter("at is null").select("id", "head", "steps").unionByName(_ranked(checkpointed(cut)).select("id", "head", "steps"))
    place = F.row_number().over(Window.partitionBy("account_id", "date").orderBy("head", "steps")) - 1
    return days.join(ranked, "id").select(F.col("id").alias("leg_id"), place.cast("long").alias("seq"))


register(
    "wn_intraday",
    lambda s, d: same_day_order(balanced_legs(s, d)),
    f"""WITH RECURSIVE {BALANCED_SQL},
asks AS (SELECT leg_id, account_id, date, balance - credit + debit AS v, row_number() OVER (PARTITION BY account_id, date, balance - credit + debit ORDER BY leg_id) AS k FROM ledger WHERE balance IS NOT NULL),
gives AS (SELECT leg_id, account_id, date, balance AS v, row_number() OVER (PARTITION BY account_id, date, balance ORDER BY leg_id) AS k FROM ledger WHERE balance IS NOT NULL),
link AS MATERIALIZED (SELECT a.leg_id AS id, g.leg_id AS before FROM asks a JOIN gives g ON a.account_id = g.account_id AND a.date = g.date AND a.v = g.v AND a.k = g.k AND a.leg_id <> g.leg_id),
chains AS (SELECT leg_id AS id, leg_id AS head, 0 AS steps FROM ledger WHERE leg_id NOT IN (SELECT id FROM link) UNION ALL SELECT l.id, head, steps + 1 FROM chains c JOIN link l ON l.before = c.id),
ring AS (SELECT id, id AS got FROM link WHERE id NOT IN (SELECT id FROM chains) UNION SELECT r.id, l.before FROM ring r JOIN link l ON l.id = r.got),
firsts AS (SELECT DISTINCT min(got) AS id FROM ring GROUP BY ring.id),
rings AS (SELECT id, id AS head, 0 AS steps FROM firsts UNION ALL SELECT l.id, head, steps + 1 FROM rings r JOIN link l ON l.before = r.id WHERE l.id <> head),
ranked AS (SELECT * FROM chains UNION ALL SELECT * FROM rings)
SELECT leg_id, row_number() OVER (PARTITION BY account_id, date ORDER BY head, steps) - 1 AS seq FROM ledger JOIN ranked ON id = leg_id""",
)
