"""Referral, guarantee, usage and competitive results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.catalog.views import sql
from sightline.operators import business as B

C = F.col
_DIMS = ("readiness", "json_ld", "citations")


def _clients(t):
    return t.score_snapshots().groupBy("project_id").agg(
        F.max("overall_score").alias("readiness"), F.max(F.when(C("project_id") % 4 != 0, C("interactivity"))).alias("json_ld"), F.min("citations").alias("citations"))


def _competitors(t):
    return t.score_snapshots().select("project_id", C("overall_score").alias("readiness"), C("interactivity").alias("json_ld"), "citations")


_BENCH = """
cl AS (UNPIVOT (SELECT project_id, max(overall_score) AS readiness, coalesce(max(interactivity) FILTER (WHERE project_id % 4 <> 0), -1) AS json_ld, min(citations) AS citations FROM score_snapshots GROUP BY 1)
  ON readiness, json_ld, citations INTO NAME dimension VALUE cv),
co AS (UNPIVOT (SELECT project_id, overall_score AS readiness, interactivity AS json_ld, citations FROM score_snapshots) ON readiness, json_ld, citations INTO NAME dimension VALUE v)"""


@query("competitor_ranking", sql(f"""WITH {_BENCH.strip()}
SELECT project_id, dimension, nullif(cv, -1) AS client_value, CASE WHEN cv >= 0 THEN 1 + count_if(v > cv) END AS rank, CASE WHEN cv >= 0 THEN floor(count_if(v < cv) * 100.0 / count(v) + 0.5)::BIGINT END AS percentile,
  floor(avg(v) * 100 + 0.5) / 100 AS average, max(v) AS best, min(v) AS worst, nullif(cv, -1) - max(v) AS gap FROM cl JOIN co USING (project_id, dimension) GROUP BY project_id, dimension, cv""", "score_snapshots"))
def competitor_ranking(t):
    return B.benchmark(_clients(t), _competitors(t), _DIMS).withColumn("percentile", C("percentile").cast("long"))


@query("citation_share", sql("""
WITH last AS (SELECT user_id AS competitor_id, arg_max(score, (scanned_at, score)) AS citations FROM scans GROUP BY 1),
rows AS (SELECT c_nationkey AS project_id, c_custkey AS competitor_id, coalesce(citations, 0) AS citations, false AS is_client FROM customer LEFT JOIN last ON competitor_id = c_custkey
  UNION ALL SELECT n_nationkey, NULL, n_nationkey * 40, true FROM nation)
SELECT project_id, competitor_id, citations, is_client, CASE WHEN t > 0 THEN floor(citations * 100.0 / t * 100 + 0.5) / 100 ELSE 0 END AS share
FROM (SELECT *, sum(citations) OVER (PARTITION BY project_id) AS t FROM rows)""", "scans"))
def citation_share(t):
    client = t.raw("nation").select(C("n_nationkey").alias("project_id"), C("n_name").alias("domain"), (C("n_nationkey") * 40).alias("citations"))
    comps = t.raw("customer").select(C("c_nationkey").alias("project_id"), C("c_custkey").alias("competitor_id"), C("c_name").alias("domain"))
    scans = t.scans().select(C("user_id").alias("competitor_id"), "scanned_at", C("score").alias("citations"))
    return B.citation_share(client, comps, scans).drop("domain")


@query("competitor_gaps", sql("""
SELECT s.project_id, s.snapshot_id, overall_score - m AS gap FROM score_snapshots s JOIN (SELECT project_id, max(overall_score) AS m FROM score_snapshots GROUP BY 1) USING (project_id)""", "score_snapshots"))
def competitor_gaps(t):
    client = t.score_snapshots().groupBy("project_id").agg(F.max("overall_score").alias("score"))
    return B.gap_rows(client, t.score_snapshots().select("project_id", "snapshot_id", C("overall_score").alias("score"))).select("project_id", "snapshot_id", "gap")


@query("weakest_checks", sql("""
SELECT scan_id, check_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score, check_id) AS rank FROM check_results WHERE status IN ('fail', 'warn')) WHERE rank <= 3""", "check_dim", "check_results"))
def weakest_checks(t):
    return B.weakest_checks(t.check_results()).select("scan_id", "check_id", "score", "rank")


_PLANS = "(VALUES ('free', 0, 3, 1), ('starter', 1, 50, 10), ('pro', 2, NULL, NULL), ('agency', 3, NULL, NULL), ('enterprise', 4, NULL, NULL)) p(plan, r, pm, pd)"


@query("scan_usage", sql(f"""
WITH u AS (SELECT c_custkey AS user_id, ['free','starter','pro','free'][c_custkey % 4 + 1] AS plan FROM customer),
s AS (SELECT user_id, count(*) AS m, count_if(strftime(scanned_at, '%Y-%m-%d') = '1997-05-28') AS d FROM scans WHERE strftime(scanned_at, '%Y-%m') = '1997-05' GROUP BY 1),
j AS (SELECT u.user_id, plan, pm, pd, coalesce(m, 0) AS m, coalesce(d, 0) AS d FROM u JOIN {_PLANS} USING (plan) LEFT JOIN s USING (user_id))
SELECT user_id, plan, m AS month_used, greatest(0, pm - m) AS month_remaining, CASE WHEN pm IS NULL THEN 0 ELSE least(100, floor(m * 100.0 / pm + 0.5)) END::BIGINT AS month_percentage,
  NOT (coalesce(m >= pm, false) OR coalesce(d >= pd, false)) AS allowed, CASE WHEN m >= pm THEN 'monthly_limit' WHEN d >= pd THEN 'daily_limit' ELSE 'ok' END AS reason,
  CASE WHEN m >= pm THEN CASE WHEN 3 >= m + 1 THEN 'free' WHEN 50 >= m + 1 THEN 'starter' ELSE 'pro' END END AS upgrade_to FROM j""", "scans"))
def scan_usage(t):
    users = t.raw("customer").select(
        C("c_custkey").alias("user_id"), F.element_at(F.array(*[F.lit(p) for p in ("free", "starter", "pro", "free")]), (C("c_custkey") % 4 + 1).cast("int")).alias("plan"))
    scans = t.scans().select("user_id", "scanned_at")
    out = B.scan_usage(scans, users, "1997-05", "1997-05-28")
    return out.select("user_id", "plan", C("monthly.used").alias("month_used"), C("monthly.remaining").alias("month_remaining"),
                      C("monthly.percentage").cast("long").alias("month_percentage"), "allowed", "reason", "upgrade_to")


_COM = """
n AS (SELECT *, row_number() OVER (PARTITION BY affiliate_id ORDER BY paid_at, invoice_id) - 1 AS prior FROM invoices WHERE net_cents > 0),
com AS (SELECT *, CASE WHEN custom_rate_bps IS NOT NULL THEN least(10000, greatest(0, custom_rate_bps)) WHEN prior >= 50 THEN 3000 WHEN prior >= 10 THEN 2500 ELSE 2000 END AS rate FROM n),
comm AS (SELECT invoice_id, affiliate_id, prior AS prior_commissions, rate::INT AS rate_bps, floor(net_cents * rate / 10000 + 0.5)::BIGINT AS amount_cents FROM com)"""


@query("commissions", sql(f"WITH {_COM.strip()} SELECT *, CASE WHEN amount_cents > 0 THEN 'recorded' ELSE 'zero_amount' END AS status FROM comm", "invoices"))
def commissions(t):
    return B.commissions(t.invoices()).drop("user_id", "net_cents", "paid_at")


@query("clawbacks", sql(f"""WITH {_COM.strip()} SELECT CASE WHEN invoice_id % 14 = 0 THEN 'refund' ELSE 'dispute' END AS reason, count(*) AS commissions, sum(amount_cents)::BIGINT AS total_cents, count(DISTINCT affiliate_id) AS affiliates
FROM comm WHERE invoice_id % 7 = 0 AND invoice_id % 3 <> 0 GROUP BY 1""", "invoices"))
def clawbacks(t):
    earned = B.commissions(t.invoices()).withColumn("status", F.when(C("invoice_id") % 3 == 0, "clawed_back").otherwise("pending"))
    refunds = t.invoices().filter(C("invoice_id") % 7 == 0).select("invoice_id", F.when(C("invoice_id") % 14 == 0, "refund").otherwise("dispute").alias("reason"))
    return B.clawbacks(earned, refunds)


@query("payout_batch", sql(f"""WITH {_COM.strip()},
bal AS (SELECT affiliate_id, sum(amount_cents)::BIGINT AS balance_cents FROM comm WHERE invoice_id % 4 = 0 AND invoice_id % 3 <> 0 GROUP BY 1)
SELECT affiliate_id, balance_cents, CASE WHEN affiliate_id % 6 = 0 THEN 'pending_exists' WHEN balance_cents < 5000 THEN 'below_minimum' ELSE 'requested' END AS decision FROM bal""", "invoices"))
def payout_batch(t):
    k = C("invoice_id")
    earned = B.commissions(t.invoices()).select(
        "affiliate_id", "amount_cents", F.when(k % 4 == 0, "approved").otherwise("pending").alias("status"), F.when(k % 3 == 0, k).alias("payout_id"))
    payouts = t.affiliates().select("affiliate_id", F.when(C("affiliate_id") % 6 == 0, "processing").otherwise("completed").alias("status"))
    return B.payout_batch(earned, payouts)


@query("fraud_flags", sql("""
WITH own AS (SELECT affiliate_id, count_if(split_part(a.email, '@', 2) = split_part(c.email, '@', 2)) AS self_referrals FROM conversions c JOIN affiliates a USING (affiliate_id) GROUP BY 1),
m AS (SELECT affiliate_id, count(*) AS cm, count_if(converted_at > TIMESTAMP '2000-06-14') AS cd, count_if(churned_at <= converted_at + INTERVAL 48 HOUR) AS ch
  FROM conversions WHERE converted_at > TIMESTAMP '2000-05-16' AND converted_at <= TIMESTAMP '2000-06-15' GROUP BY 1),
k AS (SELECT affiliate_id, count(*) AS clicks FROM clicks WHERE clicked_at > TIMESTAMP '2000-06-14' AND clicked_at <= TIMESTAMP '2000-06-15' GROUP BY 1),
f AS (SELECT affiliate_id, coalesce(self_referrals, 0) AS self_referrals, coalesce(clicks >= 500 AND coalesce(cd, 0) / clicks < 0.005, false) AS cookie_stuffing,
  coalesce(cm >= 10 AND ch / cm >= 0.3, false) AS fake_signup_churn, coalesce(cd > 20, false) AS velocity FROM affiliates LEFT JOIN own USING (affiliate_id) LEFT JOIN m USING (affiliate_id) LEFT JOIN k USING (affiliate_id))
SELECT *, self_referrals + cookie_stuffing::INT + fake_signup_churn::INT + velocity::INT AS flags, self_referrals + cookie_stuffing::INT + fake_signup_churn::INT + velocity::INT >= 3 AS suspend FROM f""", "affiliates", "conversions", "clicks"))
def fraud_flags(t):
    return B.fraud_flags(t.affiliates(), t.conversions(), t.clicks(), "2000-06-15")


@query("signup_attribution", sql("""
WITH s AS (SELECT event_id AS signup_id, user_id, CASE WHEN event_id % 4 = 1 THEN 'code' || user_id % 130 WHEN event_id % 4 = 3 THEN ' ' END AS cookie, CASE WHEN event_id % 3 = 0 THEN 'code' || user_id % 7 END AS utm, ts FROM events WHERE event_type = 'signup'),
c AS (SELECT *, coalesce(nullif(trim(cookie), ''), nullif(trim(utm), '')) AS code FROM s),
j AS (SELECT c.*, a.affiliate_id AS aff, CASE WHEN code IS NULL THEN 'no_code' WHEN a.affiliate_id IS NULL OR a.affiliate_id % 11 = 0 THEN 'link_inactive' WHEN a.status <> 'active' THEN 'affiliate_inactive' WHEN a.user_id = c.user_id THEN 'self_referral' END AS reason
  FROM c LEFT JOIN affiliates a ON code = 'code' || a.affiliate_id)
SELECT signup_id, user_id, CASE WHEN reason IS NOT NULL THEN 'no_attribution' WHEN row_number() OVER (PARTITION BY user_id, reason IS NULL ORDER BY ts, signup_id) = 1 THEN 'attributed' ELSE 'duplicate' END AS status, reason,
  CASE WHEN reason IS NULL THEN aff END AS affiliate_id, CASE WHEN reason IS NULL THEN CASE WHEN nullif(trim(cookie), '') IS NOT NULL THEN 'cookie' ELSE 'utm' END END AS method FROM j""", "affiliates"))
def signup_attribution(t):
    k = C("event_id")
    signups = t.raw("events").filter(C("event_type") == "signup").select(
        k.alias("signup_id"), "user_id", F.when(k % 4 == 1, F.concat(F.lit("code"), C("user_id") % 130)).when(k % 4 == 3, F.lit(" ")).alias("cookie_code"),
        F.when(k % 3 == 0, F.concat(F.lit("code"), C("user_id") % 7)).alias("utm_campaign"), C("ts").alias("signed_up_at"))
    links = t.affiliates().select(F.concat(F.lit("code"), C("affiliate_id")).alias("code"), "affiliate_id", (C("affiliate_id") % 11 != 0).alias("is_active"))
    return B.attribute_signups(signups, links, t.affiliates())


_CLAIMS = "cm AS (SELECT c_custkey AS claim_id, c_custkey AS user_id, c_custkey % 100 AS baseline_score, TIMESTAMP '1998-01-01' + to_days((c_custkey % 120)::INT) AS started_at, ['active','refund_requested','eligible_for_refund','improved'][c_custkey % 4 + 1] AS status FROM customer)"


def _claims(t):
    k = C("c_custkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "refund_requested", "eligible_for_refund", "improved")]), (k % 4 + 1).cast("int"))
    return t.raw("customer").select(
        k.alias("claim_id"), k.alias("user_id"), (k % 100).alias("baseline_score"),
        F.date_add(F.lit("1998-01-01").cast("date"), (k % 120).cast("int")).cast("timestamp").alias("started_at"), status.alias("status"))


@query("guarantee_milestones", sql(f"""WITH {_CLAIMS},
d AS (SELECT *, CASE WHEN age >= 90 THEN 90 WHEN age >= 60 THEN 60 WHEN age >= 30 THEN 30 END AS milestone_day FROM (SELECT *, date_diff('day', started_at, TIMESTAMP '1998-05-01') AS age FROM cm)),
l AS (SELECT user_id, arg_max(score, (scanned_at, score)) AS score FROM scans WHERE score > 0 AND scanned_at <= TIMESTAMP '1998-05-01' GROUP BY 1)
SELECT claim_id, milestone_day, baseline_score, score AS current_score, score - baseline_score AS delta, CASE WHEN milestone_day = 90 THEN CASE WHEN score > baseline_score THEN 'improved' ELSE 'eligible_for_refund' END ELSE 'interim' END AS variant
FROM d JOIN l USING (user_id) WHERE milestone_day IS NOT NULL AND NOT (claim_id % 5 = 0 AND milestone_day = 30)""", "scans"))
def guarantee_milestones(t):
    notified = _claims(t).filter(C("claim_id") % 5 == 0).select("claim_id", F.lit(30).alias("milestone_day"))
    return B.guarantee_milestones(_claims(t), t.scans(), notified, "1998-05-01")


@query("guarantee_eligibility", """
WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderkey % 5 AS p, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 % 5 END AS pp, ['DE','at','US','CH'][o_orderkey % 4 + 1] AS country FROM orders),
f AS (SELECT request_id, CASE WHEN p < 2 THEN 'plan_eligible' WHEN user_id % 6 = 0 THEN 'first_signup' WHEN p < pp THEN 'no_downgrade' WHEN user_id % 7 = 0 THEN 'no_resubscription' WHEN country = 'US' THEN 'dach_region' END AS failed_rule FROM r)
SELECT request_id, failed_rule, failed_rule IS NULL AS eligible FROM f""")
def guarantee_eligibility(t):
    k = C("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    plans = ("free", "starter", "pro", "agency", "enterprise")
    r = t.raw("orders").select(
        k.alias("request_id"), C("o_custkey").alias("user_id"), pick(plans, k % 5).alias("plan"), F.when(k % 2 == 0, pick(plans, k % 7 % 5)).alias("previous_plan"),
        pick(("DE", "at", "US", "CH"), k % 4).alias("country"))
    users = t.raw("customer").select(C("c_custkey").alias("user_id"))
    return B.guarantee_eligibility(r, users.filter(C("user_id") % 6 == 0), users.filter(C("user_id") % 7 == 0))


@query("refund_batch", sql(f"""WITH {_CLAIMS}
SELECT claim_id, count_if(has_payment) AS refunds, coalesce(sum(net_cents) FILTER (WHERE has_payment), 0)::BIGINT AS total_cents, count_if(NOT has_payment) AS skipped
FROM cm JOIN invoices USING (user_id) WHERE status IN ('refund_requested', 'eligible_for_refund') AND paid_at BETWEEN started_at AND started_at + INTERVAL 90 DAY GROUP BY 1""", "invoices"))
def refund_batch(t):
    return B.refund_batch(_claims(t), t.invoices())


@query("roi_reports", sql("""
WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, snapshot_id) AS rn FROM score_snapshots WHERE snapshot_type = 'baseline') WHERE rn = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM score_snapshots) WHERE rn = 1),
pc AS (SELECT project_id, string_agg(ai_engine || '=' || n, ',' ORDER BY ai_engine) AS platform_citations FROM (SELECT project_id, ai_engine, count(*) AS n FROM answers GROUP BY 1, 2) GROUP BY 1),
ms AS (SELECT project_id, count(*) AS milestones FROM score_snapshots WHERE overall_score >= 95 GROUP BY 1)
SELECT b.project_id, l.overall_score - b.overall_score AS overall_score_delta, l.citations - b.citations AS citations_delta, coalesce(l.readability, 0) - coalesce(b.readability, 0) AS readability_delta,
  coalesce(l.interactivity, 0) - coalesce(b.interactivity, 0) AS interactivity_delta, coalesce(l.transactional, 0) - coalesce(b.transactional, 0) AS transactional_delta,
  date_diff('day', b.created_at, l.created_at)::INT AS days, coalesce(platform_citations, '') AS platform_citations, coalesce(milestones, 0) AS milestones
FROM b JOIN l USING (project_id) LEFT JOIN pc USING (project_id) LEFT JOIN ms USING (project_id)""", "score_snapshots", "answers"))
def roi_reports(t):
    cites = t.answers().groupBy("project_id", C("ai_engine").alias("platform")).agg(F.count(F.lit(1)).alias("citations"))
    out = B.roi_report(t.score_snapshots(), cites, t.score_snapshots().filter(C("overall_score") >= 95))
    text = F.array_join(F.transform(F.map_entries("platform_citations"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("platform_citations", F.coalesce(text, F.lit("")))
