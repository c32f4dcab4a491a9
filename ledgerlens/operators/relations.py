"""Matches between accounts: transfer legs, shared parties, common times, and near duplicates of rows."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text
from ..plans.fixpoint import checkpointed
from ..plans.range_join import range_join
from ..sources.ledger_view import LEGS_SQL, TRANSFERS_SQL, legs, transfers, written_legs
from .clean import doubled
from .paths import edges, layering

#: What each score of a relationship counts.
RELATION_WEIGHTS = {"direct_transfer": 0.3, "shared_beneficiary": 0.2, "shared_source": 0.2, "community_overlap": 0.1, "temporal_correlation": 0.1, "shared_narrative": 0.1}

_UTR = "CASE WHEN rid % 29 = 0 THEN '' ELSE utr_ref END"


def match_credits(ledger: DataFrame) -> DataFrame:
    """The credit that each debit became: by reference, the nearest in time; else within a day and five percent of the amount at the named party."""
    t = F.unix_timestamp("ts")
    out = ledger.filter("debit > 0").select(F.col("leg_id").alias("debit_id"), "cp", "debit", t.alias("out_t"), F.col("utr").alias("ref"))
    back = ledger.filter("credit > 0").select(F.col("leg_id").alias("credit_id"), F.col("account_id").alias("at"), "credit", t.alias("in_t"), F.col("utr").alias("ref"))
    by_ref = out.filter("ref <> ''").join(back, "ref").groupBy("debit_id").agg(F.min_by("credit_id", F.struct(F.abs(F.col("in_t") - F.col("out_t")), "credit_id")).alias("credit_id"))
    by_ref = checkpointed(by_ref)
    rest = out.join(by_ref.select("debit_id"), "debit_id", "left_anti").select("debit_id", F.col("cp").alias("at"), "debit", "out_t", (F.col("out_t") - 86400).alias("from_t"))
    near = range_join(rest, back.drop("ref"), ["at"], "from_t", "in_t", 2 * 86400).filter(F.abs(F.col("credit") - F.col("debit")) <= F.col("debit") * F.lit("0.05").cast("decimal(3,2)"))
    guessed = near.groupBy("debit_id").agg(F.min_by("credit_id", F.struct(F.abs(F.col("credit") - F.col("debit")), F.abs(F.col("in_t") - F.col("out_t")), "credit_id")).alias("credit_id"))
    return by_ref.withColumn("how", F.lit("reference")).unionByName(guessed.withColumn("how", F.lit("amount and time")))


register(
    "jn_match_credit",
    lambda s, d: match_credits(legs(s, d).withColumn("utr", F.expr(_UTR))),
    f"""WITH {LEGS_SQL}, l AS (SELECT *, {_UTR} AS utr FROM legs),
ref AS (SELECT o.leg_id AS debit_id, b.leg_id AS credit_id, row_number() OVER (PARTITION BY o.leg_id ORDER BY abs(epoch(b.ts) - epoch(o.ts)), b.leg_id) AS k FROM l o JOIN l b ON o.utr = b.utr AND o.utr <> '' AND o.debit > 0 AND b.credit > 0),
guess AS (SELECT o.leg_id AS debit_id, b.leg_id AS credit_id, row_number() OVER (PARTITION BY o.leg_id ORDER BY abs(b.credit - o.debit), abs(epoch(b.ts) - epoch(o.ts)), b.leg_id) AS k FROM l o JOIN l b ON b.account_id = o.cp AND o.debit > 0 AND b.credit > 0
  AND b.ts BETWEEN o.ts - INTERVAL 1 DAY AND o.ts + INTERVAL 1 DAY AND abs(b.credit - o.debit) <= o.debit * 0.05 WHERE o.leg_id NOT IN (SELECT debit_id FROM ref))
SELECT debit_id, credit_id, 'reference' AS how FROM ref WHERE k = 1 UNION ALL SELECT debit_id, credit_id, 'amount and time' FROM guess WHERE k = 1""",
)


def linked_pairs(ledger: DataFrame) -> DataFrame:
    """Accounts that have dealt with each other: the candidates of relationship scores, instead of all pairs."""
    return ledger.select(F.least("account_id", "cp").alias("a"), F.greatest("account_id", "cp").alias("b")).filter("a <> b").distinct()


def parties(ledger: DataFrame, side: str) -> DataFrame:
    """(account_id, item): whom an account pays (debit) or is paid by (credit)."""
    return ledger.filter((F.col(side) > 0) & (F.col("cp") != "")).select("account_id", F.col("cp").alias("item")).distinct()


def set_classes(items: DataFrame) -> DataFrame:
    """(account_id, class, set): accounts with equal sets of items (account_id, item) are one class, named by its smallest account."""
    sets = items.groupBy("account_id").agg(F.array_sort(F.collect_set("item")).alias("set"))
    # Sets meet by a digest of their items, each with its length, so that the key is short.
    told = F.sha2(F.array_join(F.transform("set", lambda x: F.concat(F.char_length(x).cast("string"), F.lit(":"), x)), ""), 256)
    keyed = checkpointed(sets.withColumn("key", told))
    return keyed.join(keyed.groupBy("key").agg(F.min("account_id").alias("class")), "key").select("account_id", "class", "set")


def similar_sets(items: DataFrame, percent: int = 50, classes: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard, members_a, members_b) of accounts whose sets of items reach a Jaccard similarity, in percent.

    Accounts with equal sets are one class (see set_classes, which says who is in it), named by its smallest account; a
    class of several has a row with itself.  Each set is sorted from rare items to common ones.  The smaller set of a
    pair must have one of its first items among the first of the other, so an item that very many sets hold is joined
    only where rarer ones can't decide; no pair is lost.
    """
    classes = set_classes(items) if classes is None else classes
    classes = checkpointed(classes.groupBy(F.col("class").alias("id")).agg(F.first("set").alias("set"), F.count("*").alias("members")))
    parts = classes.select("id", F.size("set").alias("n"), F.explode("set").alias("item"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "item"))
    ranked = parts.join(parts.groupBy("item").agg(F.count("*").alias("df")), "item").withColumn("k", place)
    first = lambda share, of: F.col("k") <= F.col("n") + 1 - F.floor((F.col("n") * share + of - 1) / of)
    small = ranked.filter(first(2 * percent, 100 + percent)).select("item", F.col("id").alias("x"), F.col("n").alias("nx"))
    large = ranked.filter(first(percent, 100)).select("item", F.col("id").alias("y"), F.col("n").alias("ny"))
    met = small.join(large, "item").filter((F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")) & (F.col("nx") * 100 >= F.col("ny") * percent))
    pairs = checkpointed(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    near = jaccards(pairs, parts.select(F.col("id").alias("account_id"), "item")).filter(F.col("shared") * 100 >= percent * F.col("either"))
    of = lambda x: classes.select(F.col("id").alias(x), F.col("members").alias(f"members_{x}"))
    same = classes.filter("members > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"), F.col("members").alias("members_a"), F.col("members").alias("members_b"))
    return near.select("a", "b", "jaccard").join(of("a"), "a").join(of("b"), "b").select(same.columns).unionByName(same)


def jaccards(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (a, b) with shared, either (the union's size) and jaccard of their items (account_id, item).

    The items of the smaller set look for themselves in the larger one, by account and item, so neither a common item nor
    an account with very many is a key that meets all of its pairs.
    """
    n = checkpointed(items.groupBy("account_id").agg(F.count("*").alias("n")))
    sized = pairs.join(n.select(F.col("account_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("account_id").alias("b"), F.col("n").alias("nb")), "b")
    less = F.col("na") <= F.col("nb")
    turned = sized.select("a", "b", "na", "nb", F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("many"))
    both = turned.join(items.withColumnRenamed("account_id", "few"), "few").join(items.withColumnRenamed("account_id", "many"), ["many", "item"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    either = F.col("na") + F.col("nb") - F.col("shared")
    return both.select("a", "b", "shared", either.alias("either"), F.round(F.col("shared") / either, 6).alias("jaccard"))


def shared_parties(ledger: DataFrame) -> DataFrame:
    sides = {"beneficiaries": "debit", "sources": "credit"}
    return reduce(DataFrame.unionByName, (similar_sets(parties(ledger, x)).select(F.lit(k).alias("shares"), "a", "b", "jaccard", "members_a", "members_b") for k, x in sides.items()))


def _similar_sql(shares: str, side: str, percent: int = 50, name: str = "similar") -> str:
    return f"""{side}_items AS (SELECT DISTINCT account_id, cp AS item FROM legs WHERE {side} > 0 AND cp <> ''),
{side}_classes AS MATERIALIZED (SELECT min(account_id) AS id, count(*) AS members, parties, list(account_id) AS ids FROM (SELECT account_id, list_sort(list(item)) AS parties FROM {side}_items GROUP BY 1) GROUP BY parties),
{side}_parts AS MATERIALIZED (SELECT id, members, len(parties) AS n, unnest(parties) AS item FROM {side}_classes),
{side}_{name} AS MATERIALIZED (SELECT '{shares}' AS shares, x.id AS a, y.id AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard, any_value(x.members) AS members_a, any_value(y.members) AS members_b FROM {side}_parts x JOIN {side}_parts y ON x.item = y.item AND x.id < y.id GROUP BY 2, 3
  HAVING count(*) * 100 >= {percent} * (any_value(x.n) + any_value(y.n) - count(*)) UNION ALL SELECT '{shares}', id, id, 1.0, members, members FROM {side}_classes WHERE members > 1)"""


_SIMILAR = f"WITH {LEGS_SQL}, {_similar_sql('beneficiaries', 'debit')}, {_similar_sql('sources', 'credit')}"
register("fn_jaccard", lambda s, d: shared_parties(legs(s, d)), f"{_SIMILAR} SELECT * FROM debit_similar UNION ALL SELECT * FROM credit_similar")


#: In the queries some accounts have a twin with the same rows under a name of its own, so that there are equal sets.
_TWIN = "CAST(substr(account_id, 6, 3) AS INT) % 50 = 3"


def with_twins(ledger: DataFrame) -> DataFrame:
    twin = ledger.filter(F.expr(_TWIN)).withColumns({"account_id": F.concat(F.lit("B"), F.substring("account_id", 2, 7)), "leg_id": -F.col("leg_id")})
    return ledger.unionByName(twin)


_TWINS = LEGS_SQL.replace("\nlegs AS (", "\nlegs0 AS (") + f""",
legs AS (SELECT * FROM legs0 UNION ALL SELECT * REPLACE ('B' || substr(account_id, 2, 7) AS account_id, -leg_id AS leg_id) FROM legs0 WHERE {_TWIN})"""
#: From this share of equal parties on, in percent, two accounts that never dealt are a pair: 5 of 100 points from parties
#: alone need an eighth in both directions or a quarter in one.
RELATED = 12
_ALIKE = f"{_similar_sql('beneficiaries', 'debit', RELATED, 'near')}, {_similar_sql('sources', 'credit', RELATED, 'near')}"


def class_members(ledger: DataFrame) -> DataFrame:
    """(shares, account_id, class): the class of each account, by whom it pays and by whom it is paid."""
    sides = {"beneficiaries": "debit", "sources": "credit"}
    return reduce(DataFrame.unionByName, (set_classes(parties(ledger, x)).select(F.lit(k).alias("shares"), "account_id", "class") for k, x in sides.items()))


register("jn_classes", lambda s, d: class_members(with_twins(legs(s, d))), f"WITH {_TWINS}, {_ALIKE} SELECT 'beneficiaries' AS shares, account_id, id AS class FROM (SELECT id, unnest(ids) AS account_id FROM debit_classes) x UNION ALL SELECT 'sources', account_id, id FROM (SELECT id, unnest(ids) AS account_id FROM credit_classes) y")


def related_pairs(ledger: DataFrame, percent: int = RELATED) -> DataFrame:
    """(a, b): accounts that dealt with each other, those that share `percent` of whom they pay or of who pays them, and those with equal sets.

    Accounts with equal sets are pairs with their class's first account, which stands for all of them in pairs with
    other classes; class_members tells who they are.
    """
    found = [checkpointed(linked_pairs(ledger))]
    for side in ("debit", "credit"):
        classes = checkpointed(set_classes(parties(ledger, side)))
        found.append(checkpointed(similar_sets(parties(ledger, side), percent, classes).select("a", "b").filter("a <> b")))
        found.append(classes.filter("account_id <> class").select(F.col("class").alias("a"), F.col("account_id").alias("b")))
    return checkpointed(reduce(DataFrame.unionByName, found).distinct())


_PAIRS = f"WITH {_TWINS}, {_ALIKE}, pairs AS MATERIALIZED (SELECT DISTINCT least(account_id, cp) AS a, greatest(account_id, cp) AS b FROM legs WHERE account_id <> cp UNION SELECT a, b FROM debit_near WHERE a <> b UNION SELECT a, b FROM credit_near WHERE a <> b UNION SELECT id, b FROM (SELECT id, unnest(ids) AS b FROM debit_classes UNION ALL SELECT id, unnest(ids) FROM credit_classes) z WHERE id <> b)"
register("jn_pairs", lambda s, d: related_pairs(with_twins(written_legs(s, d))), f"{_PAIRS} SELECT a, b FROM pairs")


def common_times(ledger: DataFrame, pairs: DataFrame, hours: int = 2) -> DataFrame:
    """For pairs (a, b) the part of a's rows with a row of b within some hours; pairs without such rows are left out.

    The rows of a are as many for each of its pairs, so these only ask for their b's rows (a semi join) and carry nothing
    but the pair and the time; the rows of b, each once, stand in both of the time buckets that may ask for them.
    """
    t = F.unix_timestamp("ts")
    span = hours * 3600
    bucket = lambda x: F.floor(x / (2 * span))
    mine = pairs.join(ledger.select(F.col("account_id").alias("a"), (t - span).alias("t0")), "a").withColumn("at", bucket(F.col("t0")))
    theirs = checkpointed(ledger.select(F.col("account_id").alias("b"), t.alias("u")).distinct()).withColumn("at", F.explode(F.array(bucket(F.col("u")) - 1, bucket(F.col("u")))))
    near = (mine["b"] == theirs["b"]) & (mine["at"] == theirs["at"]) & (F.col("u") - F.col("t0")).between(0, 2 * span)
    hit = mine.join(theirs, near, "left_semi")
    n = ledger.groupBy(F.col("account_id").alias("a")).agg(F.count("*").alias("n"))
    return hit.groupBy("a", "b").agg(F.count("*").alias("hits")).join(n, "a").select("a", "b", F.round(F.col("hits") / F.col("n"), 6).alias("cooccurrence"))


_TIMES = f"""{_PAIRS}, hit AS (SELECT a, b, l.leg_id FROM pairs JOIN legs l ON l.account_id = a JOIN legs m ON m.account_id = b AND m.ts BETWEEN l.ts - INTERVAL 2 HOUR AND l.ts + INTERVAL 2 HOUR GROUP BY ALL),
own AS (SELECT account_id, count(*) AS rows FROM legs GROUP BY 1),
times AS (SELECT a, b, round(count(*) / any_value(own.rows), 6) AS cooccurrence FROM hit JOIN own ON account_id = a GROUP BY 1, 2)"""
register("jn_cooccur", lambda s, d: (lambda x: common_times(x, related_pairs(x)))(with_twins(written_legs(s, d))), f"{_TIMES} SELECT * FROM times")


def daily_correlation(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) the correlation of their rows a day, over the days on which either has one; 0 where it is negative or undefined."""
    days = checkpointed(ledger.groupBy("account_id", "date").agg(F.count("*").alias("n")))
    sums = days.groupBy("account_id").agg(F.count("*").alias("days"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    both = pairs.join(days.select(F.col("account_id").alias("a"), "date", F.col("n").alias("x")), "a").join(days.select(F.col("account_id").alias("b"), "date", F.col("n").alias("y")), ["b", "date"])
    both = both.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    of = lambda x: sums.select(F.col("account_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("days", "s", "q")))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").join(both, ["a", "b"], "left").fillna(0, ["common", "xy"])
    n = F.col("days_a") + F.col("days_b") - F.col("common")
    spread = lambda x: (n * F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}")).cast("double")
    r = (n * F.col("xy") - F.col("s_a") * F.col("s_b")).cast("double") / F.sqrt(F.nullif(spread("a") * spread("b"), F.lit(0.0)))
    return rows.select("a", "b", F.round(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(0.0)), 6).alias("correlation"))


_DAILY = f"""{_TIMES}, days AS MATERIALIZED (SELECT account_id, date, count(*) AS n FROM legs GROUP BY 1, 2),
sums AS (SELECT account_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS s, CAST(sum(n * n) AS BIGINT) AS q FROM days GROUP BY 1),
common AS (SELECT a, b, count(*) AS common, CAST(sum(x.n * y.n) AS BIGINT) AS xy FROM pairs JOIN days x ON x.account_id = a JOIN days y ON y.account_id = b AND y.date = x.date GROUP BY 1, 2),
moments AS (SELECT a, b, p.s AS sa, q.s AS sb, p.q AS qa, q.q AS qb, p.days + q.days - coalesce(common, 0) AS n, coalesce(xy, 0) AS xy FROM pairs JOIN sums p ON p.account_id = a JOIN sums q ON q.account_id = b LEFT JOIN common USING (a, b)),
daily AS (SELECT a, b, round(greatest(coalesce(CAST(n * xy - sa * sb AS DOUBLE) / sqrt(nullif(CAST(n * qa - sa * sa AS DOUBLE) * CAST(n * qb - sb * sb AS DOUBLE), 0)), 0), 0), 6) AS correlation FROM moments)"""
register("wn_daily_corr", lambda s, d: (lambda x: daily_correlation(x, related_pairs(x)))(with_twins(written_legs(s, d))), f"{_DAILY} SELECT * FROM daily")


def relationships(ledger: DataFrame, community: DataFrame | None = None) -> DataFrame:
    """Six scores of each related pair, their weighted sum, its type and a confidence.

    `community` is (account_id, community_id); without it nothing is scored for a common community.  A pair that isn't
    related (see related_pairs) gets no row: parties give it less than 5 points, times, words and community 30 at most.
    """
    pairs = related_pairs(ledger)
    paid = ledger.filter("debit > 0").groupBy(F.least("account_id", "cp").alias("a"), F.greatest("account_id", "cp").alias("b")).agg(F.count("*").alias("txns"), F.sum("debit").cast("double").alias("moved"))
    words = ledger.select("account_id", F.explode(text.tokens(F.col("narration"))).alias("item")).distinct()
    score = lambda items, name: jaccards(pairs, items).select("a", "b", (F.col("shared") / F.col("either") * 100).alias(name))
    rows = pairs.join(paid, ["a", "b"], "left")
    for part in (score(parties(ledger, "debit"), "shared_beneficiary"), score(parties(ledger, "credit"), "shared_source"), score(words, "shared_narrative"), common_times(ledger, pairs), daily_correlation(ledger, pairs)):
        rows = rows.join(part, ["a", "b"], "left")
    n = ledger.groupBy("account_id").agg(F.count("*").alias("n"))
    rows = rows.join(n.select(F.col("account_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("account_id").alias("b"), F.col("n").alias("nb")), "b")
    if community is None:
        rows = rows.withColumn("community_overlap", F.lit(0.0))
    else:
        rows = rows.join(community.select(F.col("account_id").alias("a"), F.col("community_id").alias("ca")), "a", "left").join(community.select(F.col("account_id").alias("b"), F.col("community_id").alias("cb")), "b", "left")
        rows = rows.withColumn("community_overlap", F.when(F.col("ca") == F.col("cb"), 100.0).otherwise(0.0))
    rows = rows.fillna(0.0, ["shared_beneficiary", "shared_source", "shared_narrative", "cooccurrence", "correlation"])
    rows = rows.withColumn("direct_transfer", F.when(F.col("txns") > 0, F.least(F.lit(100.0), 15.0 * F.col("txns") + 10.0 * F.log1p("moved"))).otherwise(0.0))
    rows = rows.withColumn("temporal_correlation", 50.0 * F.col("correlation") + 50.0 * F.col("cooccurrence"))
    total = sum((w * F.col(c) for c, w in RELATION_WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("score", F.least(F.lit(100.0), total))
    kind = F.when(F.col("direct_transfer") >= 50, "Direct Transactor").when((F.col("shared_beneficiary") >= 40) & (F.col("shared_source") >= 40), "Shared Infrastructure").when((F.col("temporal_correlation") >= 40) & (F.col("community_overlap") >= 50), "Co-active Layering")
    kind = kind.when(F.col("score") >= 25, "Suspicious Association").when(F.col("score") >= 5, "Weak Association").otherwise("Unrelated")
    active = sum((F.when(F.col(c) >= 10, 1).otherwise(0) for c in RELATION_WEIGHTS), F.lit(0))
    sure = F.least(F.lit(100.0), 20.0 * active + 10.0 * F.log1p(F.col("na") + F.col("nb")))
    return rows.select(F.col("a").alias("account_a"), F.col("b").alias("account_b"), *(F.round(c, 1).alias(f"{c}_score") for c in RELATION_WEIGHTS), F.round("score", 1).alias("relationship_score"), kind.alias("relationship_type"), F.round(sure, 1).alias("confidence"), F.col("txns").isNotNull().alias("has_direct_txn"))


_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS))
_RELATIONS = rf"""{_DAILY}, paid AS (SELECT least(account_id, cp) AS a, greatest(account_id, cp) AS b, count(*) AS txns, CAST(sum(debit) AS DOUBLE) AS moved FROM legs WHERE debit > 0 GROUP BY 1, 2),
words AS MATERIALIZED (SELECT DISTINCT account_id, item FROM (SELECT account_id, unnest(regexp_extract_all(lower(narration), '\b([a-z0-9]{{3,}})\b', 1)) AS item FROM legs) WHERE item NOT IN ({_STOP})),
""" + ", ".join(f"""{x}_share AS (SELECT a, b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS shared FROM pairs JOIN (SELECT *, count(*) OVER (PARTITION BY account_id) AS n FROM {x}) p ON p.account_id = a JOIN (SELECT *, count(*) OVER (PARTITION BY account_id) AS n FROM {x}) q ON q.account_id = b AND q.item = p.item GROUP BY 1, 2)""" for x in ("debit_items", "credit_items", "words")) + """,
scored AS (SELECT a, b, txns, CASE WHEN txns > 0 THEN least(100.0, 15.0::DOUBLE * txns + 10.0::DOUBLE * ln(1 + moved)) ELSE 0 END AS d, coalesce(x.shared / (x.na + x.nb - x.shared) * 100, 0) AS sb, coalesce(y.shared / (y.na + y.nb - y.shared) * 100, 0) AS ss,
  coalesce(z.shared / (z.na + z.nb - z.shared) * 100, 0) AS sn, 50.0::DOUBLE * correlation + 50.0::DOUBLE * coalesce(cooccurrence, 0) AS tc, o.rows + r.rows AS n FROM pairs LEFT JOIN paid USING (a, b) LEFT JOIN debit_items_share x USING (a, b) LEFT JOIN credit_items_share y USING (a, b) LEFT JOIN words_share z USING (a, b)
  LEFT JOIN times USING (a, b) LEFT JOIN daily USING (a, b) JOIN own o ON o.account_id = a JOIN own r ON r.account_id = b),
total AS (SELECT *, least(100.0::DOUBLE, 0.3::DOUBLE * d + 0.2::DOUBLE * sb + 0.2::DOUBLE * ss + 0.1::DOUBLE * tc + 0.1::DOUBLE * sn) AS t FROM scored),
relations AS (SELECT a AS account_a, b AS account_b, round(d, 1) AS direct_transfer_score, round(sb, 1) AS shared_beneficiary_score, round(ss, 1) AS shared_source_score, 0.0::DOUBLE AS community_overlap_score, round(tc, 1) AS temporal_correlation_score, round(sn, 1) AS shared_narrative_score, round(t, 1) AS relationship_score,
  CASE WHEN d >= 50 THEN 'Direct Transactor' WHEN sb >= 40 AND ss >= 40 THEN 'Shared Infrastructure' WHEN t >= 25 THEN 'Suspicious Association' WHEN t >= 5 THEN 'Weak Association' ELSE 'Unrelated' END AS relationship_type,
  round(least(100.0::DOUBLE, 20.0::DOUBLE * ((d >= 10)::INT + (sb >= 10)::INT + (ss >= 10)::INT + (tc >= 10)::INT + (sn >= 10)::INT) + 10.0::DOUBLE * ln(1 + n)), 1) AS confidence, txns IS NOT NULL AS has_direct_txn FROM total)"""
register("gr_relationship", lambda s, d: relationships(with_twins(legs(s, d))), f"{_RELATIONS} SELECT * FROM relations")


def longest_chains(chains: DataFrame) -> DataFrame:
    """Chains whose accounts aren't all in a longer chain; only chains that share the smallest account are compared."""
    own = chains.select(F.array_sort("nodes").alias("accounts")).distinct()
    longer = own.select(F.explode("accounts").alias("at"), F.col("accounts").alias("other"))
    inside = own.withColumn("at", F.get("accounts", 0)).join(longer, "at").filter((F.size("other") > F.size("accounts")) & (F.size(F.array_except("accounts", "other")) == 0))
    return own.join(inside.select("accounts").distinct(), "accounts", "left_anti")


register(
    "st_subset_dedup",
    lambda s, d: longest_chains(layering(edges(transfers(s, d)))).select(F.array_join("accounts", ",").alias("accounts"), F.size("accounts").cast("long").alias("n")),
    f"""WITH RECURSIVE {TRANSFERS_SQL},
edges AS (SELECT 'A' || lpad(CAST(src AS VARCHAR), 7, '0') AS src, 'A' || lpad(CAST(dst AS VARCHAR), 7, '0') AS dst, amt, epoch(ts)::BIGINT AS t FROM transfers),
large AS MATERIALIZED (SELECT * FROM edges WHERE CAST(amt AS DOUBLE) >= (SELECT quantile_cont(CAST(amt AS DOUBLE), 0.6) FROM edges)),
paths AS (SELECT [src, dst] AS nodes, amt, t, dst AS last, 1 AS n FROM large
  UNION ALL SELECT list_append(nodes, e.dst), e.amt, e.t, e.dst, n + 1 FROM paths p JOIN large e ON e.src = p.last AND e.t >= p.t AND e.t - p.t <= 259200 AND e.amt >= p.amt * 0.5 AND NOT list_contains(nodes, e.dst) WHERE n < 6),
own AS MATERIALIZED (SELECT DISTINCT list_sort(nodes) AS accounts FROM paths WHERE n >= 3),
longer AS MATERIALIZED (SELECT unnest(accounts) AS acct, accounts AS other FROM own),
inside AS (SELECT DISTINCT accounts FROM own JOIN longer ON acct = accounts[1] AND len(other) > len(accounts) AND list_has_all(other, accounts))
SELECT array_to_string(accounts, ',') AS accounts, len(accounts) AS n FROM own WHERE accounts NOT IN (SELECT accounts FROM inside)""",
)


def near_duplicates(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Later rows of equal account, day and amounts whose narration is almost that of the group's first row."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    order = Window.partitionBy("account_id", "date", "debit", "credit").orderBy("pos")
    later = rows.withColumns({"first": F.first("narration").over(order), "k": F.row_number().over(order)}).filter("k > 1")
    return later.filter(ratio("first", "narration") >= least)


register("st_near_dup", lambda s, d: near_duplicates(doubled(s, d)).select("leg_id", "copy"))
