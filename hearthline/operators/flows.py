"""Monthly stocks and flows, churn, and re-entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.columns import (
    as_instant,
    last_value,
    month_start,
    ratio,
    round_to,
    sequence_key,
    truth,
)
from hearthline.operators.master import event_key
from hearthline.operators.sequence import running_total, with_previous
from hearthline.schema import ALWAYS_ELIGIBLE, LOST_FOR_GOOD, NEVER_ELIGIBLE


def monthly_flag(df: DataFrame, keys: list[str], date: str, flag: Column, key: Column) -> DataFrame:
    """Last known flag per key and month; unknown counts as false.

    Aggregated before any window, so a household contributes one row per month.
    """
    known = df.where(F.col(date).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys, month_start(F.col(date)).alias("month")).agg(
        truth(last_value(flag, key, flag.isNotNull())).alias("flag")
    )


def with_last_month(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Add the flag of the previous observed month of the same key."""
    months = Window.partitionBy(*keys).orderBy("month")
    return monthly.withColumn("was", F.lag("flag").over(months))


def carried_flows(monthly: DataFrame, group: str) -> DataFrame:
    """Flows and stocks per group and month when a flag holds until it changes.

    ``entries`` and ``exits`` count changes of keys seen before; keys seen for
    the first time enter the stocks without being an entry. Stocks are running
    sums of the flows over the few months of a group.
    """
    now, was = F.col("flag"), F.col("was")
    flows = (
        with_last_month(monthly, [group, "menage_ano"])
        .groupBy(group, "month")
        .agg(
            F.count_if(now & ~was).alias("entries"),
            F.count_if(~now & was).alias("exits"),
            F.count_if(now & was.isNull()).alias("first_on"),
            F.count_if(~now & was.isNull()).alias("first_off"),
        )
    )
    gain = F.col("entries") + F.col("first_on") - F.col("exits")
    loss = F.col("exits") + F.col("first_off") - F.col("entries")
    return flows.select(
        "*",
        running_total(gain, [group], "month").alias("stock_on"),
        (running_total(gain, [group], "month") - gain).alias("stock_on_before"),
        running_total(loss, [group], "month").alias("stock_off"),
    )


def build_monthly_eligibility_flows(master: DataFrame) -> DataFrame:
    """Eligible and other households per month, and changes since their last month."""
    monthly = monthly_flag(
        master, ["menage_ano"], "date_calcul", F.col("eligible"), event_key(master)
    )
    now, was = F.col("flag"), truth(F.col("was"))
    up, down = F.count_if(now & ~was), F.count_if(~now & was)
    return (
        with_last_month(monthly, ["menage_ano"])
        .groupBy("month")
        .agg(
            F.count_if(now).alias("unique_menages_eligible"),
            F.count_if(~now).alias("unique_menages_not_eligible"),
            up.alias("menages_became_eligible"),
            down.alias("menages_became_ineligible"),
            (up + down).alias("n_transitions"),
        )
        .select(as_instant(F.col("month")).alias("date"), "*")
        .drop("month")
        .orderBy("date")
    )


def build_monthly_beneficiary_flows(beneficiaries: DataFrame) -> DataFrame:
    """Active and inactive households per partner and month, carried between months."""
    ties = [F.col(c) for c in ("motif",) if c in beneficiaries.columns]
    key = sequence_key(F.col("date_insert"), *ties, F.col("actif"))
    monthly = monthly_flag(
        beneficiaries, ["partner_id", "menage_ano"], "date_insert", F.col("actif"), key
    )
    return (
        carried_flows(monthly, "partner_id")
        .select(
            as_instant(F.col("month")).alias("date"),
            F.upper("partner_id").alias("programme"),
            F.col("stock_on").alias("unique_menages_eligible"),
            F.col("stock_off").alias("unique_menages_not_eligible"),
            (F.col("entries") + F.col("first_on")).alias("menages_became_eligible"),
            F.col("exits").alias("menages_became_ineligible"),
        )
        .orderBy("programme", "date")
    )


def build_churn_timeline(master: DataFrame) -> DataFrame:
    """Eligible pool, entries, exits and their rates per programme and month."""
    monthly = monthly_flag(
        master,
        ["programme", "menage_ano"],
        "date_calcul",
        F.col("eligible"),
        event_key(master),
    )
    start = F.col("stock_on_before")
    return (
        carried_flows(monthly, "programme")
        .select(
            as_instant(F.col("month")).alias("date"),
            "programme",
            start.alias("pool_start"),
            F.col("stock_on").alias("pool_end"),
            "entries",
            "exits",
            ratio(F.col("exits"), start).alias("churn_rate"),
            ratio(F.col("entries"), start).alias("acquisition_rate"),
            ratio(F.col("entries") - F.col("exits"), start).alias("net_rate"),
        )
        .orderBy("programme", "date")
    )


def churn_table(churn: DataFrame, programmes: list[str] | None = None) -> DataFrame:
    """Churn timeline as a table: month label and rates in percent."""
    chosen = churn if not programmes else churn.where(F.col("programme").isin(*programmes))
    return chosen.select(
        F.date_format("date", "yyyy-MM").alias("mois"),
        "programme",
        "pool_start",
        "pool_end",
        "entries",
        "exits",
        *[
            round_to(F.col(c) * 100, 2).alias(f"{c}_pct")
            for c in ("churn_rate", "acquisition_rate", "net_rate")
        ],
    ).orderBy("programme", "mois")


def beneficiary_kpis(flows: DataFrame) -> DataFrame:
    """Peaks of the stocks, the first month they were reached, and total changes."""

    def peak(column: str) -> Column:
        return F.date_format(
            F.max_by(F.col("date"), F.struct(F.col(column), -F.unix_date(F.col("date").cast("date")))),
            "yyyy-MM",
        )

    return flows.groupBy("programme").agg(
        F.max("unique_menages_eligible").alias("max_eligible"),
        F.max("unique_menages_not_eligible").alias("max_not_eligible"),
        peak("unique_menages_eligible").alias("mois_max_eligible"),
        peak("unique_menages_not_eligible").alias("mois_max_not_eligible"),
        F.sum("menages_became_eligible").alias("became_eligible"),
        F.sum("menages_became_ineligible").alias("became_ineligible"),
    )


def build_reentry_detail(master: DataFrame) -> DataFrame:
    """Returns to eligibility per household and programme, over consecutive events.

    The first event never counts; a gain after having been excluded does.
    """
    ties = [c for c in ("score_id_ano",) if c in master.columns]
    rows = (
        master.where(F.col("menage_ano").isNotNull() & F.col("programme").isNotNull())
        .select("menage_ano", "programme", "date_calcul", *ties, truth(F.col("eligible")).alias("eligible"))
    )
    pairs = with_previous(rows, ["menage_ano", "programme"], "date_calcul", ties, ["eligible"])
    back = F.col("eligible") & ~F.col("previous.eligible")
    return pairs.groupBy("menage_ano", "programme").agg(
        F.count_if(back).alias("n_reentries"),
        F.bool_or("eligible").alias("ever_eligible"),
        (~F.every("eligible")).alias("ever_lost"),
    )


def build_reentry_summary(detail: DataFrame) -> DataFrame:
    """Households per programme and number of re-entries.

    Those without any re-entry are split in three groups that are always listed,
    even when empty.
    """
    n, ever, lost = F.col("n_reentries"), F.col("ever_eligible"), F.col("ever_lost")
    counts = detail.groupBy(
        "programme",
        F.when(n > 0, n)
        .when(~lost, F.lit(-3))
        .when(~ever, F.lit(-2))
        .otherwise(F.lit(-1))
        .alias("code"),
    ).agg(F.count("*").alias("n_menages"))
    per_programme = counts.groupBy("programme").agg(
        F.sum("n_menages").alias("total"),
        *[
            F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n_menages"))), F.lit(0)).alias(name)
            for c, name in ((-3, "always"), (-2, "never"), (-1, "lost"))
        ],
    )

    def line(label: str, column: str, order: int) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            F.col(column).alias("n_menages"),
            F.lit(order).cast("long").alias("code"),
        )

    fixed = per_programme.select(
        "programme",
        "total",
        F.inline(
            F.array(
                line(ALWAYS_ELIGIBLE, "always", -3),
                line(NEVER_ELIGIBLE, "never", -2),
                line(LOST_FOR_GOOD, "lost", -1),
            )
        ),
    )
    repeated = (
        counts.where(F.col("code") > 0)
        .join(per_programme.select("programme", "total"), "programme")
        .select(
            "programme", "total", F.col("code").cast("string").alias("label"), "n_menages", "code"
        )
    )
    return (
        fixed.unionByName(repeated)
        .orderBy("programme", "code")
        .select(
            "programme",
            F.col("label").alias("n_reentries"),
            "n_menages",
            F.coalesce(
                round_to(ratio(F.col("n_menages"), F.col("total")) * 100, 2), F.lit(0.0)
            ).alias("pct_menages"),
        )
    )


def reentry_stats(detail: DataFrame) -> DataFrame:
    """Per programme: households, those with a re-entry, and how many they had."""
    back = F.col("n_reentries") > 0
    total, again = F.count("*"), F.count_if(back)
    return detail.groupBy("programme").agg(
        total.alias("total_menages"),
        again.alias("n_avec_reentree"),
        round_to(ratio(again, total) * 100, 1).alias("pct_avec_reentree"),
        F.max("n_reentries").alias("max_reentrees"),
        round_to(F.avg(F.when(back, F.col("n_reentries"))), 2).alias(
            "avg_reentrees_parmi_churners"
        ),
    )


def reentry_buckets(summary: DataFrame, top: int = 5) -> DataFrame:
    """Summary with all counts from ``top`` on merged into one line."""
    label = F.col("n_reentries")
    count = label.try_cast("int")
    merged = F.when(count >= top, F.lit(f"{top}+")).otherwise(label)
    order = (
        F.when(label == ALWAYS_ELIGIBLE, F.lit(-3))
        .when(label == NEVER_ELIGIBLE, F.lit(-2))
        .when(label == LOST_FOR_GOOD, F.lit(-1))
        .otherwise(F.least(count, F.lit(top)))
    )
    return (
        summary.groupBy("programme", merged.alias("label"), order.alias("ordre"))
        .agg(
            F.sum("n_menages").alias("n_menages"),
            round_to(F.sum("pct_menages"), 2).alias("pct_menages"),
        )
        .orderBy("programme", "ordre")
    )
