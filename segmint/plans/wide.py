"""The customer-wide row.

One row per customer: attributes, spend and income averages of the last three
month-end snapshots, and activity of four channels.  Each block is an
aggregate keyed by ``PERS_ID``; the blocks are left-joined to the base.  No
block reads data a chosen projection does not need: Catalyst prunes unused
columns, and an unused left-joined aggregate is removed altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.functions.dates import month_end_of, month_start_of
from segmint.operators.features import attach, category_averages, category_sums, channel_averages, unique
from segmint.plans import domain as d
from segmint.sources.store import MonthStore


def spend_income_block(spark: SparkSession, root: str, as_of=d.AS_OF,
                       classes: dict[str, str] | None = None, sums: bool = False) -> DataFrame:
    """Monthly averages (or raw sums) of the listed transaction classes.

    Spend and income classes share the class column, so by default both
    pivots are ONE conditional aggregate over one scan of the window.
    """
    trn = d.transactions(spark, root, as_of)
    cats = classes if classes is not None else {**d.SPEND_CLASSES, **d.INCOME_CLASSES}
    if sums:
        return category_sums(trn, d.KEY, "TRN_CLASS_DESCR", cats, "CNT", "AMT")
    return category_averages(trn, d.KEY, "TRN_CLASS_DESCR", cats, d.MONTHS, "CNT", "AMT")


def event_channel_block(spark: SparkSession, root: str, as_of=d.EVENT_AS_OF,
                        channels: list[str] | None = None) -> DataFrame:
    """Digital / POS / ATM activity: one pass over the event fact."""
    preds = d.channel_predicates()
    if channels is not None:
        preds = {k: v for k, v in preds.items() if k in channels}
    common = d.event_window(as_of) & (F.col("AMT") > 0)
    return channel_averages(d.event_fact(spark, root), d.KEY, preds, "AMT", d.MONTHS,
                            common=common, names=d.CHANNEL_NAMES)


def branch_block(spark: SparkSession, root: str, as_of=d.AS_OF) -> DataFrame:
    """Branch visits and amounts from the pre-aggregated branch fact."""
    return channel_averages(d.branch_fact(spark, root, as_of), d.KEY, {"BRNCH": F.lit(True)},
                            "AMT", d.MONTHS, weight="N", names=d.CHANNEL_NAMES)


def channel_activity(spark: SparkSession, root: str, base: DataFrame | None = None,
                     as_of=d.AS_OF, event_as_of=d.EVENT_AS_OF) -> DataFrame:
    """Base customers with the four channels' counts and amounts."""
    base = base if base is not None else d.customers(spark, root).select(d.KEY)
    wide = attach(base, d.KEY, [event_channel_block(spark, root, event_as_of),
                                branch_block(spark, root, as_of)])
    cnts = [d.CHANNEL_NAMES[c][0] for c in d.CHANNEL_NAMES]
    amts = [d.CHANNEL_NAMES[c][1] for c in d.CHANNEL_NAMES]
    return wide.select(d.KEY, *cnts, *amts)


def line_facts(spark: SparkSession, root: str, as_of=d.AS_OF) -> DataFrame:
    """``(PERS_ID, branch visits and amount, 28 segment-fact measures)``; the fact is null without a line in the last month."""
    lines = d.line_block(spark, root, as_of)
    count, amount = d.CHANNEL_NAMES["BRNCH"]
    whole = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    per = lines.groupBy(d.KEY).agg(F.nullif(F.sum("N"), F.lit(0)).alias("n"), F.sum("AMT").alias("amt"), F.sum("__lines").alias("__lines"),
                                   *[whole[fn](name).alias(name) for name, (fn, _) in d.SEGMENT_FACT.items()])
    here = F.col("__lines") > 0
    fact = [F.when(here, F.col(c) if c in d.FLAG_MEASURES else F.col(c).cast("double")).alias(c) for c in d.SEGMENT_FACT]
    return per.select(d.KEY, (F.col("n") / F.lit(float(d.MONTHS))).alias(count), F.round(F.col("amt") / F.lit(d.MONTHS), 1).cast("double").alias(amount), *fact)


def customer_wide(spark: SparkSession, root: str, as_of=d.AS_OF, event_as_of=d.EVENT_AS_OF,
                  active_only: bool = True, check: bool = False, tenure: DataFrame | None = None) -> DataFrame:
    """The wide customer row: attributes and six blocks, all by ``PERS_ID``.

    Pivots, activity and the customer fact come from one scan of orders; branch visits
    and the segment fact from one scan of lines.
    ``active_only`` keeps the reference's base (customers active in the last month:
    the fact's flag); ``False`` builds the row for every customer.  With ``check`` a
    customer that stands twice in the base (a repeated customer or nation row) is an error
    when the row is evaluated.  ``tenure`` may be given, see :func:`tenure_from_store`.
    """
    base = d.customer_profile(spark, root)
    wide = attach(unique(base, d.KEY) if check else base, d.KEY, [d.order_block(spark, root, as_of)])
    if active_only:
        wide = wide.where(F.col("M_ACT_FLAG") == 1)
    tenure = tenure if tenure is not None else d.tenure(spark, root, as_of)
    wide = attach(wide, d.KEY, [tenure, event_channel_block(spark, root, event_as_of), line_facts(spark, root, as_of)])
    return wide.select(d.KEY, *d.REPORTING_VARIABLES, *d.MODEL_VARIABLES, d.SECOND_KEY, *d.CUSTOMER_FACT, *d.SEGMENT_FACT)


def tenure_from_store(spark: SparkSession, root: str, store: MonthStore, source: str, as_of=d.AS_OF) -> DataFrame:
    """``(PERS_ID, TENURE)`` as :func:`segmint.plans.domain.tenure`, from the stored first orders of the month before.

    The store holds each customer's first order up to a month end.  A month's state is that of the month before and
    the orders of the one new month; only where that is not there is the whole history read.
    """
    snap, before = month_end_of(as_of, 1), month_end_of(as_of, 2)
    params = {"source": source, "state": "first order"}

    def first_orders(since=None) -> DataFrame:
        o = d.table(spark, root, "orders").where(F.col("o_orderdate") < F.lit(month_start_of(as_of, 0)))
        o = o if since is None else o.where(F.col("o_orderdate") >= F.lit(since))
        return o.groupBy(F.col("o_custkey").alias(d.KEY)).agg(F.min("o_orderdate").alias("first_order"))

    def state() -> DataFrame:
        known = store.read(before, params)
        if known is None:
            return first_orders()
        return known.unionByName(first_orders(month_start_of(as_of, 1))).groupBy(d.KEY).agg(F.min("first_order").alias("first_order"))

    return store.read_or_build(snap, params, state).select(d.KEY, d.years_since("first_order", snap).alias("TENURE"))


def segment_input(spark: SparkSession, root: str) -> DataFrame:
    """Application input for filters and models: the wide row of every customer."""
    return customer_wide(spark, root, active_only=False)
