"""First-party evidence for a candidate: exclusion, machine blockers, status of official feeds, admission to ranking.

Inputs are tables: page evidence (page_status, date_posted, expired, remote_signal, applicant_locations, apply_http_status,
form_detected, page_language, application_language, visible_text) beside the candidate's columns.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import is_true, iso_date
from gleaner.operators.ranking import Policy, top_vacancies
from gleaner.operators.requirements import geography

MATCHING = "matching_first_party_jobposting"
#: Digests that an admitted row must carry.
DIGESTS = ("assessment_sha256", "policy_sha256", "candidate_evidence_sha256", "observation_sha256", "official_page_sha256")


def _age(posted: Column, today: date) -> Column:
    return F.datediff(F.lit(today), F.when(F.length(posted) == 10, iso_date(posted)))


def _too_old(age: Column, policy: Policy) -> Column:
    return F.lit(policy.max_posting_age_days > 0) & (age > policy.max_posting_age_days)


def page_exclusion(today: date, policy: Policy) -> Column:
    """Reason to drop a role that only its own page can give; null keeps it."""
    age = _age(F.col("date_posted"), today)
    return F.when(F.col("page_status") == "closed_at_exact_ats_route", "official_job_route_closed").when(
        F.col("page_status") == MATCHING,
        F.when(is_true(F.col("expired")), "official_job_expired").when((age >= 0) & _too_old(age, policy), "official_original_post_too_old"),
    )


#: Travel with its share, words by which a share is no duty, and wording that takes residents of other regions only.
TRAVEL = r"\b(?:travelling|traveling|travel)\b[^\n.!?]{0,120}?\b(\d{1,3})\s*(?:[-–—]\s*\d{1,3})?\s*%"
NO_TRAVEL = r"up to|\b(?:optional|costs?|expenses?|reimburs\w*|discounts?|subsid\w*|allowances?|benefits?)\b"
REGION = r"(?:north\s+america|united\s+states|u\.s\.a?\.?|usa|canada|australia|india|brazil|mexico|philippines|south\s+africa)"
ONLY_RESIDENTS = (
    r"\b(?:only|exclusively)\s+(?:consider(?:ing)?|accept(?:ing)?|hir(?:e|ing)|recruit(?:ing)?)\s+(?:[\w'-]+\s+){0,4}?(?:candidates?|applicants?|people|employees?)\s+"
    r"(?:[\w'-]+\s+){0,4}?(?:based|located|residing|living)\s+(?:in\s+)?(?:the\s+)?" + REGION + r"\b"
)
MUST_RESIDE = r"\b(?:applicants?|candidates?|employees?)\s+must\s+(?:currently\s+)?(?:be\s+)?(?:based|located|residing|living)\s+(?:in\s+)?(?:the\s+)?" + REGION + r"\b"


def substantial_travel(text: Column) -> Column:
    """Required travel of a fifth or more; optional, capped and paid-for travel does not count."""
    found = F.regexp_extract_all(F.substring(text, 1, 25_000), F.lit(f"(?iu){TRAVEL}"), F.lit(0))
    share = lambda s: F.regexp_extract(s, f"(?iu){TRAVEL}", 1).cast("int")
    return F.coalesce(F.exists(found, lambda s: (share(s) >= 20) & ~s.rlike(f"(?iu){NO_TRAVEL}")), F.lit(False))


def exclusive_residency(text: Column) -> Column:
    """The page takes residents of another region only."""
    return F.coalesce(F.substring(text, 1, 25_000).rlike(f"(?iu){ONLY_RESIDENTS}|{MUST_RESIDE}"), F.lit(False))


def blockers(today: date, policy: Policy) -> Column:
    """Ordered reasons why a candidate cannot be ranked by machine alone; the last one is always there."""
    age, page = _age(F.col("date_posted"), today), F.col("page_status") == MATCHING
    not_ = lambda c: ~F.coalesce(c, F.lit(False))
    checks = [
        (not_(F.col("official_role") == "confirmed_current_public_ats"), "official_employer_and_exact_role"),
        (not_(page), "matching_visible_first_party_job_page"),
        (age.isNull(), "original_publication_date"),
        ((age < 0) | _too_old(age, policy), "valid_original_publication_date"),
        (is_true(F.col("expired")), "unexpired_official_role"),
        (not_((F.col("remote_check") == "confirmed") & F.col("remote_signal")), "fully_remote_from_first_party"),
        (page & substantial_travel(F.col("visible_text")), "substantial_required_travel"),
        (page & exclusive_residency(F.col("visible_text")), "exclusive_non_nl_residence_on_official_page"),
        (not_((F.col("netherlands") == "allowed") & (geography(F.array_join("applicant_locations", ", ")) == "allowed")), "netherlands_executable_from_employer"),
        (not_((F.col("apply_http_status") == 200) & F.col("form_detected")), "verified_application_form_at_exact_route"),
    ]
    if policy.allowed_listing_languages is not None:
        allowed = sorted(policy.allowed_listing_languages)
        checks += [
            (not_(F.col("page_language").isin(*allowed)), "verified_listing_language"),
            (not_(F.col("application_language").isin(*allowed)), "employer_authorized_application_language"),
            (F.lit(True), "employer_required_work_languages"),
        ]
    checks += [
        (not_((F.col("requirement_status") == "mapped_skills_have_evidence") & (F.col("technical_requirements") >= 1)), "complete_candidate_requirement_evidence"),
        (F.lit(True), "verified_core_duties_and_score_anchors"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))


def official_status(today: date, policy: Policy) -> Column:
    """struct of what an official feed proves by itself; a feed's date can only rule a role out."""
    official, place, work = is_true(F.col("from_official_feed")), F.lower(F.coalesce("location", F.lit(""))), F.lower(F.coalesce("workplace_type", F.lit("")))
    onsite = r"\b(?:on.?site|in.?office|office only|hybrid)\b"
    age = F.datediff(F.lit(today), iso_date(F.substring("published_at", 1, 10)))
    remote = (
        F.when(is_true(F.col("remote")) | (work == "remote"), "confirmed")
        .when((F.col("remote") == F.lit(False)) | work.rlike(onsite) | place.rlike(onsite), "not_remote")
        .when(place.rlike(r"\b(?:remote|work from home|distributed)\b"), "needs_structured_confirmation")
        .otherwise("unknown")
    )
    fields = {
        "official_role": (F.lit("confirmed_current_public_ats"), "unverified"),
        "role_open": (F.lit("present_in_live_official_feed"), "unknown"),
        "remote": (remote, "unknown"),
        "netherlands": (geography(F.col("location")), "unknown"),
        "original_publication": (F.when(age < 0, "future_publication_invalid").when(_too_old(age, policy), "too_old").otherwise("unknown"), "unknown"),
        "language": (F.when(F.lower("listing_language").isin("en", "nl"), "listed_language_supported_application_unverified").otherwise("unknown"), "unknown"),
    }
    return F.struct(*[F.when(official, v).otherwise(F.lit(d)).alias(n) for n, (v, d) in fields.items()])


def rank_verified(rows: DataFrame, today: date, policy: Policy) -> DataFrame:
    """Rank the rows whose verification is complete, of today, and carries all digests; others can't enter by their scores."""
    fine = (F.col("authenticity") == "verified") & F.col("role_open") & (F.col("reviewed_on") == today.isoformat())
    for d in DIGESTS:
        fine = fine & F.col(d).rlike("^[0-9a-f]{64}$")
    fine = fine & F.col("requirements").between(1, 100) & (F.col("mandatory_requirements") >= 0) & (F.col("mandatory_requirements") <= F.col("requirements"))
    return top_vacancies(rows.where(F.coalesce(fine, F.lit(False))), today, policy)
