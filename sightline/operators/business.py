"""Referral, guarantee, usage and competitive rules as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.numbers import clamp, round_half_up
from sightline.functions.text import email_domain
from sightline.operators.skew import latest_per_key, ordinal, top_k_per_key

C = F.col
DIMENSIONS = ("readiness", "json_ld", "llms_txt", "agents_md", "citations")


def benchmark(client: DataFrame, competitors: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Client against competitors per project and dimension: rank, percentile beaten, mean, best, worst, gap.

    Missing values leave a competitor out of that dimension. Both sides are unpivoted; the client row joins on
    (project, dimension) and everything is one aggregate with map-side partials.
    """
    mine = client.unpivot(["project_id"], list(dimensions), "dimension", "client_value")
    others = competitors.select("project_id", *dimensions).unpivot(["project_id"], list(dimensions), "dimension", "value")
    j = mine.join(others.filter(C("value").isNotNull()), ["project_id", "dimension"], "left")
    v, c = C("value"), C("client_value")
    known = c.isNotNull() & v.isNotNull()
    return j.groupBy("project_id", "dimension", "client_value").agg(
        F.when(F.count("value") > 0, F.when(F.first("client_value").isNotNull(), 1 + F.count_if(known & (v > c)))).alias("rank"),
        F.when(F.count_if(known) > 0, round_half_up(F.count_if(known & (v < c)) * 100 / F.count("value"))).alias("percentile"),
        round_half_up(F.avg("value"), 2).alias("average"), F.max("value").alias("best"), F.min("value").alias("worst"),
    ).withColumn("gap", C("client_value") - C("best"))


def citation_share(client: DataFrame, competitors: DataFrame, scans: DataFrame) -> DataFrame:
    """Share of citations of the client and each competitor per project, in percent with two decimals.

    ``client`` (project_id, domain, citations), ``competitors`` (project_id, competitor_id, domain), ``scans``
    (competitor_id, scanned_at, citations): the latest scan counts, none counts as 0.
    """
    last = latest_per_key(scans.select("competitor_id", "scanned_at", "citations"), ["competitor_id"], ["scanned_at", "citations"])
    others = competitors.join(last, "competitor_id", "left").select(
        "project_id", "domain", "competitor_id", F.coalesce("citations", F.lit(0)).alias("citations"), F.lit(False).alias("is_client"))
    own = client.select("project_id", "domain", F.lit(None).cast("long").alias("competitor_id"), "citations", F.lit(True).alias("is_client"))
    rows = own.unionByName(others)
    totals = rows.groupBy("project_id").agg(F.sum("citations").alias("_total"))
    return rows.join(totals, "project_id").withColumn(
        "share", F.when(C("_total") > 0, round_half_up(C("citations") * 100 / C("_total"), 2)).otherwise(0.0)).drop("_total")


def gap_rows(client: DataFrame, competitors: DataFrame) -> DataFrame:
    """Competitor rows of a report with the gap of their score to the client's."""
    return competitors.join(client.select("project_id", C("score").alias("client_score")), "project_id").withColumn(
        "gap", C("score") - C("client_score"))


def weakest_checks(checks: DataFrame, key: str = "scan_id", k: int = 3) -> DataFrame:
    """The ``k`` checks a scan should mend first: lowest score, then id."""
    failing = checks.filter(C("status").isin("fail", "warn"))
    return top_k_per_key(failing, [key], [C("score"), C("check_id")], k)


# --- usage ------------------------------------------------------------------------------------------


def plan_limits(column: int, plan: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for p in K.PLANS for x in (F.lit(p[0]), F.lit(p[column]).cast("int"))]), plan)


def usage_metric(used: Column, limit: Column) -> Column:
    """Struct of used, limit, remaining and percentage; no limit means nothing is used up."""
    return F.struct(
        used.alias("used"), limit.alias("limit"), F.greatest(F.lit(0), limit - used).alias("remaining"),
        F.when(limit.isNull(), 0).when(limit == 0, 100).otherwise(F.least(F.lit(100), round_half_up(used * 100 / F.nullif(limit, F.lit(0))))).alias("percentage"))


def scan_usage(scans: DataFrame, users: DataFrame, month: str, day: str) -> DataFrame:
    """Monthly and daily scans against the plan, with the quota decision.

    ``scans`` (user_id, scanned_at), ``users`` (user_id, plan), ``month`` ``yyyy-MM``, ``day`` ``yyyy-MM-dd``.
    """
    at = C("scanned_at")
    first = F.to_timestamp(F.lit(f"{month}-01"))  # a half-open range reaches the scan
    used = scans.filter((at >= first) & (at < F.add_months(F.lit(f"{month}-01").cast("date"), 1).cast("timestamp"))).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_m"), F.count_if(F.date_format(at, "yyyy-MM-dd") == day).alias("_d"))
    j = users.join(used, "user_id", "left").withColumns({"_m": F.coalesce("_m", F.lit(0)), "_d": F.coalesce("_d", F.lit(0))})
    monthly, daily = plan_limits(2, C("plan")), plan_limits(3, C("plan"))
    plans = [p for p in K.PLANS]
    upgrade = F.coalesce(*[
        F.when(F.lit(p[2]).cast("int").isNull() | (F.lit(p[2]).cast("int") >= C("_m") + 1), F.lit(p[0])) for p in plans])
    over_month = F.coalesce(C("_m") >= monthly, F.lit(False))
    over_day = F.coalesce(C("_d") >= daily, F.lit(False))
    return j.select(
        "user_id", "plan", usage_metric(C("_m"), monthly).alias("monthly"), usage_metric(C("_d"), daily).alias("daily"),
        (~over_month & ~over_day).alias("allowed"),
        F.when(over_month, "monthly_limit").when(over_day, "daily_limit").otherwise("ok").alias("reason"),
        F.when(over_month, upgrade).alias("upgrade_to"))


# --- referral ----------------------------------------------------------------------------------------


def commissions(invoices: DataFrame) -> DataFrame:
    """Commission per invoice: tier by the number of earlier commissions of the affiliate, or a custom rate.

    Invoices without a positive amount earn nothing and do not count for the tier. Numbering runs per affiliate
    and day and is then shifted, so a busy affiliate is not sorted in one task.
    """
    paid = ordinal(invoices.filter(C("net_cents") > 0), ["affiliate_id"], ["paid_at", "invoice_id"], "_n")
    prior = C("_n") - 1
    tier = F.lit(K.COMMISSION_TIERS[0][1])
    for least, bps in K.COMMISSION_TIERS[1:]:
        tier = F.when(prior >= least, bps).otherwise(tier)
    rate = F.when(C("custom_rate_bps").isNotNull(), clamp(C("custom_rate_bps"), 0, 10_000)).otherwise(tier).cast("int")
    amount = round_half_up(C("net_cents") * rate / 10_000)
    return paid.select(
        "invoice_id", "affiliate_id", "user_id", "net_cents", "paid_at", prior.alias("prior_commissions"), rate.alias("rate_bps"),
        amount.alias("amount_cents"), F.when(amount > 0, "recorded").otherwise("zero_amount").alias("status"))


def clawbacks(earned: DataFrame, refunds: DataFrame) -> DataFrame:
    """Commissions of refunded invoices not yet clawed back: count, sum and affiliates per refund batch."""
    hit = earned.filter(C("status") != "clawed_back").join(refunds.select("invoice_id", "reason").distinct(), "invoice_id")
    return hit.groupBy("reason").agg(
        F.count(F.lit(1)).alias("commissions"), F.sum("amount_cents").alias("total_cents"),
        F.count_distinct("affiliate_id").alias("affiliates"))


def payout_batch(earned: DataFrame, payouts: DataFrame, minimum: int = K.MIN_PAYOUT_CENTS) -> DataFrame:
    """Payout decision per affiliate from its approved commissions without a payout.

    ``earned`` (affiliate_id, amount_cents, status, payout_id), ``payouts`` (affiliate_id, status). One open payout
    at most; balances under the minimum wait.
    """
    open_payouts = payouts.filter(C("status").isin(*K.OPEN_PAYOUT_STATES)).select("affiliate_id", F.lit(True).alias("_open")).distinct()
    balance = earned.filter((C("status") == "approved") & C("payout_id").isNull()).groupBy("affiliate_id").agg(
        F.sum("amount_cents").alias("balance_cents"))
    return balance.join(open_payouts, "affiliate_id", "left").select(
        "affiliate_id", "balance_cents",
        F.when(C("_open"), "pending_exists").when(C("balance_cents") <= 0, "no_balance")
        .when(C("balance_cents") < minimum, "below_minimum").otherwise("requested").alias("decision"))


def fraud_flags(affiliates: DataFrame, conversions: DataFrame, clicks: DataFrame, as_of: str) -> DataFrame:
    """Fraud flags per affiliate as of a time: self-referral, cookie stuffing, early churn, velocity; and suspension.

    Self-referrals compare the e-mail domains (and addresses and payment fingerprints, where both tables have
    them) of affiliate and referred user.
    """
    now = F.to_timestamp(F.lit(as_of))
    day, month = now - F.expr("INTERVAL 24 HOURS"), now - F.expr("INTERVAL 30 DAYS")
    conv, click = C("converted_at"), C("clicked_at")
    owner = affiliates.select("affiliate_id", email_domain(C("email")).alias("_owner"), *[
        C(c).alias(f"_owner_{c}") for c in ("ip", "fingerprint") if c in affiliates.columns and c in conversions.columns])
    pairs = conversions.join(owner, "affiliate_id")
    same = (C("_owner") != "") & (C("_owner") == email_domain(C("email")))
    for c in ("ip", "fingerprint"):
        if f"_owner_{c}" in pairs.columns:
            same = same | F.coalesce(C(c) == C(f"_owner_{c}"), F.lit(False))
    own = pairs.groupBy("affiliate_id").agg(F.count_if(same).alias("self_referrals"))
    early = C("churned_at") <= conv + F.expr("INTERVAL 48 HOURS")
    stats = conversions.filter((conv > month) & (conv <= now)).groupBy("affiliate_id").agg(
        F.count_if(conv > day).alias("conv_day"), F.count(F.lit(1)).alias("conv_month"), F.count_if(early).alias("churned"))
    clicked = clicks.filter((click > day) & (click <= now)).groupBy("affiliate_id").agg(F.count(F.lit(1)).alias("clicks_day"))
    j = affiliates.select("affiliate_id").join(own, "affiliate_id", "left").join(stats, "affiliate_id", "left").join(
        clicked, "affiliate_id", "left").na.fill(0)
    ratio = C("conv_day") / F.nullif("clicks_day", F.lit(0))
    t = K.FRAUD
    flags = {
        "cookie_stuffing": (C("clicks_day") >= t["clicks_per_day"]) & (ratio < t["conversion_ratio"]),
        "fake_signup_churn": (C("conv_month") >= t["churn_min_sample"]) & (C("churned") / F.nullif("conv_month", F.lit(0)) >= t["churn_rate"]),
        "velocity": C("conv_day") > t["conversions_per_day"],
    }
    count = C("self_referrals") + sum((F.coalesce(c, F.lit(False)).cast("int") for c in flags.values()), F.lit(0))
    return j.select(
        "affiliate_id", "self_referrals", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()],
        count.alias("flags"), (count >= t["suspend_flags"]).alias("suspend"))


def attribute_signups(signups: DataFrame, links: DataFrame, affiliates: DataFrame) -> DataFrame:
    """Which affiliate a signup belongs to, or why none.

    ``signups`` (signup_id, user_id, cookie_code, utm_campaign, signed_up_at), ``links`` (code, affiliate_id,
    is_active), ``affiliates`` (affiliate_id, user_id, status). The cookie beats the campaign; the first attributed
    signup of a user wins.
    """
    cookie, campaign = F.nullif(F.btrim("cookie_code"), F.lit("")), F.nullif(F.btrim("utm_campaign"), F.lit(""))
    s = signups.withColumn("code", F.coalesce(cookie, campaign))
    j = s.join(links.select("code", "affiliate_id", "is_active"), "code", "left").join(
        affiliates.select("affiliate_id", C("user_id").alias("_owner"), C("status").alias("_status")), "affiliate_id", "left")
    reason = (
        F.when(C("code").isNull(), "no_code")
        .when(~F.coalesce("is_active", F.lit(False)), "link_inactive")
        .when(F.coalesce("_status", F.lit("")) != "active", "affiliate_inactive")
        .when(C("_owner") == C("user_id"), "self_referral")
    )
    j = j.withColumn("reason", reason)
    first = j.filter(C("reason").isNull()).groupBy("user_id").agg(F.min(F.struct("signed_up_at", "signup_id")).alias("_first"))
    j = j.join(first, "user_id", "left")
    is_first = F.struct("signed_up_at", "signup_id") == C("_first")
    return j.select(
        "signup_id", "user_id",
        F.when(C("reason").isNotNull(), "no_attribution").when(is_first, "attributed").otherwise("duplicate").alias("status"),
        "reason", F.when(C("reason").isNull(), C("affiliate_id")).alias("affiliate_id"),
        F.when(C("reason").isNull(), F.when(cookie.isNotNull(), "cookie").otherwise("utm")).alias("method"))


# --- guarantee ---------------------------------------------------------------------------------------


def guarantee_milestones(claims: DataFrame, scores: DataFrame, notified: DataFrame, as_of: str, threshold: int = 0) -> DataFrame:
    """Due milestone (day 30, 60 or 90) per claim with the change against its baseline, and the day-90 decision.

    ``claims`` (claim_id, user_id, baseline_score, started_at), ``scores`` (user_id, score, scanned_at), ``notified``
    (claim_id, milestone_day). The latest positive score up to the date counts; claims without one are left out.
    """
    now = F.to_timestamp(F.lit(as_of))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("started_at")) / 86400)
    due = F.lit(None).cast("int")
    for day in K.GUARANTEE_DAYS:
        due = F.when(age >= day, day).otherwise(due)
    open_claims = claims.withColumn("milestone_day", due).filter(C("milestone_day").isNotNull()).join(
        notified, ["claim_id", "milestone_day"], "left_anti")
    latest = latest_per_key(
        scores.filter((C("score") > 0) & (C("scanned_at") <= now)).select("user_id", "score", "scanned_at"),
        ["user_id"], ["scanned_at", "score"])
    delta = C("score") - C("baseline_score")
    return open_claims.join(latest, "user_id").select(
        "claim_id", "milestone_day", "baseline_score", C("score").alias("current_score"), delta.alias("delta"),
        F.when(C("milestone_day") == 90, F.when(delta > threshold, "improved").otherwise("eligible_for_refund")).otherwise("interim").alias("variant"))


def guarantee_eligibility(requests: DataFrame, prior_claims: DataFrame, cancellations: DataFrame) -> DataFrame:
    """First of five ordered rules that a request fails, or eligible.

    ``requests`` (request_id, user_id, plan, previous_plan, country).
    """
    good = [p[0] for p in K.PLANS if p[6]]
    rank = lambda c: F.try_element_at(F.create_map(*[x for p in K.PLANS for x in (F.lit(p[0]), F.lit(p[1]))]), C(c))
    seen = prior_claims.select("user_id", F.lit(True).alias("_claim")).distinct()
    left = cancellations.select("user_id", F.lit(True).alias("_cancelled")).distinct()
    j = requests.join(seen, "user_id", "left").join(left, "user_id", "left")
    failed = (
        F.when(~C("plan").isin(*good), "plan_eligible")
        .when(C("_claim"), "first_signup")
        .when(rank("plan") < rank("previous_plan"), "no_downgrade")
        .when(C("_cancelled"), "no_resubscription")
        .when(~F.coalesce(F.upper("country").isin(*K.DACH), F.lit(False)), "dach_region")
    )
    return j.select("request_id", failed.alias("failed_rule"), failed.isNull().alias("eligible"))


def refund_batch(claims: DataFrame, invoices: DataFrame) -> DataFrame:
    """Refundable claims with their paid invoices of the first 90 days: number, sum, and invoices without payment id.

    ``claims`` (claim_id, user_id, status, started_at), ``invoices`` (invoice_id, user_id, net_cents, paid_at,
    has_payment). The join is on the user, the period a filter on top.
    """
    ok = claims.filter(C("status").isin("refund_requested", "eligible_for_refund") & C("user_id").isNotNull())
    j = ok.join(invoices, "user_id").filter(
        (C("paid_at") >= C("started_at")) & (C("paid_at") <= C("started_at") + F.expr("INTERVAL 90 DAYS")))
    paid = C("has_payment")
    return j.groupBy("claim_id").agg(
        F.count_if(paid).alias("refunds"), F.coalesce(F.sum(F.when(paid, C("net_cents"))), F.lit(0)).alias("total_cents"),
        F.count_if(~paid).alias("skipped"))


def roi_report(snapshots: DataFrame, citations: DataFrame, milestones: DataFrame) -> DataFrame:
    """Baseline against latest per project: deltas, days elapsed, citations per platform, number of milestones.

    ``citations`` (project_id, platform, citations). A missing sub-score counts as 0; the platform map has one entry
    per platform. The milestones themselves stay rows.
    """
    order = F.struct("created_at", "snapshot_id")
    cols = ["overall_score", "citations", "created_at", *[c for c in K.CATEGORIES]]
    row = F.struct(*cols)
    is_base = C("snapshot_type") == "baseline"
    ends = snapshots.groupBy("project_id").agg(
        F.min_by(F.when(is_base, row), F.when(is_base, order)).alias("b"), F.max_by(row, order).alias("l")).filter(C("b").isNotNull())
    platforms = citations.groupBy("project_id", "platform").agg(F.sum("citations").alias("n")).groupBy("project_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("platform_citations"))
    counted = milestones.groupBy("project_id").agg(F.count(F.lit(1)).alias("milestones"))
    delta = lambda c: (F.coalesce(C(f"l.{c}"), F.lit(0)) - F.coalesce(C(f"b.{c}"), F.lit(0))).alias(f"{c}_delta")
    return ends.join(platforms, "project_id", "left").join(counted, "project_id", "left").select(
        "project_id", delta("overall_score"), delta("citations"), *[delta(c) for c in K.CATEGORIES],
        F.datediff("l.created_at", "b.created_at").alias("days"), "platform_citations", F.coalesce("milestones", F.lit(0)).alias("milestones"))
