"""One pass over a run's observations: screening, official pages within a budget, assessments, ranking, counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import is_true, iso_date
from gleaner.functions.urls import role_specific
from gleaner.operators import assessment, evidence, identity, planning, review, screening
from gleaner.operators.canonical import clusters
from gleaner.operators.graph import stash
from gleaner.operators.ranking import Policy
from gleaner.operators.requirements import region_conflict

#: titles' terms of the role families, and a forum whose posts offer work instead of asking for it.
TITLE_TERMS = {
    "wordpress_ecosystem": ("wordpress", "woocommerce", "elementor", "gutenberg"),
    "web_design_development": ("web designer", "web developer", "webdesigner", "webdeveloper", "frontend", "front-end", "front end"),
    "ai_workflow_automation": ("workflow automation", "ai automation", "automation engineer", "n8n"),
}
FORUM = r"^https://community\.n8n\.io/.*/t/available-|^https://community\.n8n\.io/t/available-"


@dataclass
class Evaluation:
    judged: DataFrame  # candidates with reject_reason, page status, assessment status, missing
    recommended: DataFrame  # ranked
    counts: DataFrame  # by reject_reason


def screened(observations: DataFrame, known: DataFrame, weak: DataFrame, active: DataFrame, policy: Policy, today: date, limit: int, order: list | None = None) -> DataFrame:
    """observations (ordinal, ...) with keys, url, hints and reject_reason, the first of the rules that excludes a row.

    known: key, of what was registered before; weak: employer, title, folded; active: source_id. Rows that share a key are
    one, the first in order; only what a source states itself excludes, what is unknown stays.
    """
    allowed = sorted(policy.allowed_listing_languages or ())
    o = observations.join(active.select("source_id", F.lit(True).alias("_active")).distinct(), "source_id", "left").withColumn("keys", identity.history_keys(observations))
    o = o.withColumn("url", identity.safe_url(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")))).withColumn("hints", review.role_hints(F.col("title"), F.col("description"), F.col("source_type"), tuple(sorted(policy.target_role_families)), TITLE_TERMS))
    o = stash(o, "screened")  # long expressions end here, so that plans stay small
    hit = o.select("ordinal", F.explode("keys").alias("key")).join(known.select("key").distinct(), "key", "left_semi").select("ordinal", F.lit(True).alias("_known")).distinct()
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    w = weak.select(F.col("employer").alias("_e"), F.col("title").alias("_t"), F.lit(True).alias("_weak")).distinct()
    o = o.join(hit, "ordinal", "left").join(w, (low("employer") == F.col("_e")) & (low("title") == F.col("_t")), "left")
    linked = clusters(o.where("_active").select("ordinal", "keys"), F.col("keys")).select("ordinal", "cluster")
    o = o.join(linked, "ordinal", "left")
    age = review.observed_age(F.col("source_type"), F.col("published_at"), F.lit(today))
    language = low("listing_language")
    wrong = ((F.col("source_type") == "ats") & (F.col("remote") == F.lit(False))) | ((language != "") & ~language.isin(*allowed)) | (age < 0) | (F.lit(policy.max_posting_age_days > 0) & (age > policy.max_posting_age_days))
    rules = [
        ("unapproved_source", F.col("_active").isNull()),
        ("unsafe_link", F.col("url").isNull() | ~role_specific(F.col("url"))),
        ("duplicate", F.col("cluster") != F.col("ordinal")),
        ("previously_registered", F.col("_known")),
        ("source_expired", iso_date(F.substring("valid_through", 1, 10)) < F.lit(today)),
        ("explicit_mismatch", wrong),
        ("non_job_page", F.lower("url").rlike(FORUM)),
        ("source_location_restricted", region_conflict(F.col("location"), F.col("location_restrictions"), F.col("description"), F.col("source_type"), True).isNotNull() & ~is_true(F.col("verified_account"))),
        ("possible_prior_match", is_true(F.col("_weak")) & (low("employer") != "") & (low("title") != "")),
        ("off_target", F.size("hints") == 0),
    ]
    return screening.cascade(o, rules, order or [F.col("ordinal")], limit).drop("_active", "_known", "_e", "_t", "_weak", "cluster")


def evaluate(
    observations: DataFrame, known: DataFrame, weak: DataFrame, active: DataFrame, fetched: DataFrame, assessments: DataFrame, claims: DataFrame, config: DataFrame, policy: Policy, today: date,
    limit: int = 60, page_budget: int = 10, *, reviewer: str,
) -> Evaluation:
    """Screen, look at pages, validate and rank.

    observations hold provider and account where their account is verified. fetched: url, http_status, html. assessments:
    canonical_url, assessment. claims: the candidate's evidence. config: key, value.
    """
    o = observations.withColumn("verified_account", F.col("provider").isNotNull() & F.col("account").isNotNull())
    judged = stash(screened(o, known, weak, active, policy, today, limit), "judged")
    kept = judged.where("reject_reason is null and verified_account").withColumn("canonical_url", F.col("url"))
    kept = stash(planning.page_budget(kept, "canonical_url", [F.col("ordinal")], page_budget), "kept")
    pages = stash(assessment.official_evidence(kept.where("in_budget"), fetched, F.lit(today)), "pages")
    bound = assessment.bind(kept, pages, config, claims)
    seen = kept.join(pages.withColumnRenamed("status", "page_status"), "canonical_url", "left").join(bound, "canonical_url", "left")
    signals = F.col("structured")
    seen = seen.withColumns({
        "date_posted": signals["date_posted"], "page_date_posted": signals["date_posted"], "expired": signals["expired_by_valid_through"], "remote_signal": signals["remote_signal"],
        "applicant_locations": signals["applicant_locations"], "form_detected": F.col("application_form_detected"), "from_official_feed": F.lit(True),
        "account_verified": F.lit(True), "role_family_hints": F.col("hints"), "requirement_status": F.lit(None).cast("string"), "technical_requirements": F.lit(None).cast("int"),
    })
    seen = seen.withColumn("_s", evidence.official_status(today, policy)).withColumns({"official_role": F.col("_s.official_role"), "remote_check": F.col("_s.remote"), "netherlands": F.col("_s.netherlands")})
    seen = seen.withColumn("exclusion", evidence.page_exclusion(today, policy)).withColumn("blockers", evidence.blockers(today, policy))
    seen = stash(seen.drop("_s"), "seen")
    decided = stash(assessment.validate(seen.where("in_budget and exclusion is null"), assessments, claims, today, policy, reviewer=reviewer), "decided")
    recommended = evidence.rank_verified(decided.where("status = 'verified'"), today, policy)
    result = decided.select(F.col("canonical_url").alias("url"), "status", "missing")
    out = judged.join(seen.select("ordinal", "page_status", "exclusion", "in_budget"), "ordinal", "left").join(result, "url", "left")
    late = F.when(F.col("exclusion").isNotNull(), F.col("exclusion")).when(F.col("status") == "ineligible", "verified_mandatory_requirement_mismatch")
    out = out.withColumn("reject_reason", F.coalesce("reject_reason", late)).withColumn("missing", F.when(is_true(~F.col("in_budget")), F.array(F.lit("official_page_check_budget_reached"))).otherwise(F.col("missing")))
    return Evaluation(out, recommended, screening.reason_counts(out))


@dataclass
class Pass:
    evaluation: Evaluation
    rounds: list[tuple[int, int]]  # batch and verified roles after it; a run has few batches
    stop_reason: str


def one_pass(observations: DataFrame, batches: DataFrame, *, target: int, exhaustive: bool = False, **inputs) -> Pass:
    """Batches of sources one after the other (planning.batch_plan), each judged with all before it, until `target` roles are verified.

    observations: source_instance and evaluate()'s columns; batches: source_instance, batch; inputs: evaluate()'s others.
    An instance counts in its first batch. Exhaustive runs take all batches and judge once, as they can't stop early.
    """
    first = batches.groupBy("source_instance").agg(F.min("batch").alias("batch"))
    numbers = [r[0] for r in first.select("batch").distinct().orderBy("batch").collect()]
    rows = stash(observations.join(first, "source_instance"), "gathered")
    rounds: list[tuple[int, int]] = []
    out, reason = None, "planned_sources_exhausted"
    for b in numbers[-1:] if exhaustive else numbers:
        out = evaluate(rows.where(F.col("batch") <= b).drop("batch"), **inputs)
        rounds.append((b, out.recommended.count()))
        if not exhaustive and rounds[-1][1] >= target:
            reason = "verified_target_reached"
            break
    return Pass(out or evaluate(rows.limit(0).drop("batch"), **inputs), rounds, reason)
