"""Deterministic gate, score and top-k of vacancies.

Everything is a few narrow projections and one TakeOrderedAndProject: no shuffle of the input, no Python. Parts that are
used more than once are columns of a projection of their own, so that the optimizer does not copy them into every use.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import LANGUAGE_ALIASES, finite, is_true, iso_date, language, role_family, variant_number

#: Steps of the three fit scores, and the families a policy can name.
CORE_STEPS = (0.0, 25.0, 40.0, 50.0)
EVIDENCE_STEPS = (0.0, 10.0, 18.0, 25.0)
WORKSTYLE_STEPS = (0.0, 5.0, 10.0, 15.0)
FAMILIES = ("wordpress_ecosystem", "ai_workflow_automation", "web_design_development")
FAMILY_FLAGS = {"wordpress_related": FAMILIES[0], "ai_workflow_related": FAMILIES[1], "web_design_related": FAMILIES[2]}
DEFAULT_FAMILIES = frozenset(FAMILIES[:1])


@dataclass(frozen=True)
class Policy:
    min_monthly_salary_eur: float
    max_posting_age_days: int  # 0: no limit
    max_output_roles: int
    min_output_score: float
    min_core_fit: float
    min_evidence_fit: float
    allowed_listing_languages: frozenset[str] | None = None  # None: languages are not gated
    target_role_families: frozenset[str] = DEFAULT_FAMILIES

    def __post_init__(self) -> None:
        for name, low, high in (
            ("min_monthly_salary_eur", 0, math.inf),
            ("max_posting_age_days", 0, math.inf),
            ("max_output_roles", 1, math.inf),
            ("min_output_score", 0, 100),
            ("min_core_fit", 0, 50),
            ("min_evidence_fit", 0, 25),
        ):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")

    @classmethod
    def from_config(cls, config: Mapping[str, object]) -> Policy:
        """Policy of a key/value register; wrong or missing values fail before any job runs."""

        def number(key: str, whole: bool = False) -> float:
            value = config.get(key)
            if isinstance(value, bool) or not isinstance(value, (int, float, str)):
                raise ValueError(f"policy key {key} must be numeric")
            try:
                x = float(value)
            except ValueError:
                raise ValueError(f"policy key {key} must be numeric") from None
            if not math.isfinite(x) or whole and x != int(x):
                raise ValueError(f"policy key {key} must be {'an integer' if whole else 'finite'}")
            return int(x) if whole else x

        def items(key: str) -> list[str]:
            value = config[key]
            if not isinstance(value, (str, list, tuple, set, frozenset)):
                raise ValueError(f"policy key {key} must be CSV text or a list")
            return [x.strip().lower() for x in (value.split(",") if isinstance(value, str) else value)]

        if "allowed_listing_languages" not in config:
            raise ValueError("policy key allowed_listing_languages is missing")
        found = {LANGUAGE_ALIASES.get(x.replace("_", "-"), x.replace("_", "-").removesuffix(x[2:]) if x[:3] in ("nl-", "en-", "nl_", "en_") else x) for x in items("allowed_listing_languages")}
        if not found or any(len(x) != 2 or not x.isalpha() for x in found):
            raise ValueError("policy key allowed_listing_languages has an invalid language")
        families = DEFAULT_FAMILIES
        if "target_role_families" in config:
            families = frozenset("_".join(filter(None, "".join(c if c.isalnum() else " " for c in x).split())) for x in items("target_role_families"))
            if not families or families - set(FAMILIES):
                raise ValueError("policy key target_role_families has unsupported families")
        return cls(
            number("min_monthly_salary_eur"),
            int(number("max_posting_age_days", True)),
            int(number("max_output_roles", True)),
            number("min_output_score"),
            number("min_core_fit"),
            number("min_evidence_fit"),
            frozenset(found),
            families,
        )


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _amount(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Whether an amount is given, and its value if it is a valid one."""
    x = _has(df, name, "double")
    if dict(df.dtypes).get(name) == "variant":
        given = x.isNotNull() & ~F.coalesce(F.is_variant_null(x), F.lit(True))
        value = variant_number(x)
    elif dict(df.dtypes).get(name) in ("string", "boolean"):
        given, value = x.isNotNull(), F.lit(None).cast("double")  # text and flags are not amounts
    else:
        given, value = x.isNotNull(), finite(x)
    return given, F.when(value >= 0, value)


def _amounts(df: DataFrame) -> dict[str, Column]:
    """Columns `_given_*` and `_value_*` of the exact amount and both ends of a range."""
    out = {}
    for k in ("", "min_", "max_"):
        out[f"_given_{k}"], out[f"_value_{k}"] = _amount(df, f"salary_{k}monthly_eur")
    return out


def _salary(minimum: float) -> tuple[Column, Column]:
    """(known, status) from the columns of _amounts."""
    (has_x, x), (has_lo, lo), (has_hi, hi) = ((F.col(f"_given_{k}"), F.col(f"_value_{k}")) for k in ("", "min_", "max_"))
    wrong = (has_x & (has_lo | has_hi)) | (has_x & x.isNull()) | (has_lo & lo.isNull()) | (has_hi & hi.isNull()) | F.coalesce(lo > hi, F.lit(False))
    status = (
        F.when(wrong, "salary_invalid")
        .when(~(has_x | has_lo | has_hi), "salary_unknown")
        .when(F.coalesce(x, hi) < minimum, "salary_below_preference")
    )
    return ~wrong & (has_x | has_lo | has_hi), status


def salary_status(df: DataFrame, minimum: float) -> DataFrame:
    """df with salary_known and salary_status: an exact amount or a range, not both."""
    known, status = _salary(minimum)
    return df.withColumns(_amounts(df)).select(*df.columns, known.alias("salary_known"), status.alias("salary_status"))


def recency_points(age: Column) -> Column:
    return F.when(age <= 14, 10.0).when(age <= 30, 8.0).when(age <= 60, 6.0).when(age <= 90, 4.0).otherwise(2.0)


def role_families(df: DataFrame) -> Column:
    raw = _has(df, "role_families", "array<string>")
    named = F.split(raw, ",") if dict(df.dtypes).get("role_families") == "string" else raw
    known = F.filter(F.transform(F.coalesce(named, F.array().cast("array<string>")), role_family), lambda x: x.isin(*FAMILIES))
    flags = [F.when(is_true(_has(df, c, "boolean")), F.lit(f)) for c, f in FAMILY_FLAGS.items()]
    return F.array_distinct(F.concat(known, F.array_compact(F.array(*flags))))


def eligibility(df: DataFrame, today: date, policy: Policy) -> DataFrame:
    """df with gate: struct(pass, reasons, warnings, age_days, salary_known); reasons in the order of the rules."""
    family = F.lit(False)
    for column, name in FAMILY_FLAGS.items():
        if name in policy.target_role_families and column in df.columns:
            family = family | is_true(F.col(column))
    if "role_families" in df.columns:
        family = family | is_true(F.arrays_overlap(role_families(df), F.array(*[F.lit(x) for x in sorted(policy.target_role_families)])))
    need = _has(df, "required_languages", "array<string>")
    if dict(df.dtypes).get("required_languages") == "string":
        items = F.filter(F.split(need, ","), lambda i: F.trim(i) != "")
        need = F.when(F.size(items) > 0, items)
    raw = _has(df, "posted_date", "string")
    parts = {"_dated": raw.isNotNull(), "_posted": iso_date(raw), "_codes": F.transform(need, language)}
    parts |= {f"_{n}": language(_has(df, n, "string")) for n in ("listing_language", "application_language")} | _amounts(df)
    known, status = _salary(policy.min_monthly_salary_eur)
    age = F.col("_age")
    checks = [
        F.when(F.col("_dated") & F.col("_posted").isNull(), "date_invalid")
        .when(age < 0, "future_date")
        .when(F.lit(policy.max_posting_age_days > 0) & (age > policy.max_posting_age_days), "older_than_max_age"),
        F.when(~is_true(_has(df, "fully_remote", "boolean")), "not_remote"),
        F.when(~is_true(_has(df, "geography_compatible", "boolean")), "country_restriction"),
        F.when(~is_true(family), "not_wordpress_related" if policy.target_role_families == DEFAULT_FAMILIES else "not_target_role_family"),
        F.when(is_true(_has(df, "central_hard_mismatch", "boolean")), "central_hard_mismatch"),
    ]
    if policy.allowed_listing_languages is not None:
        allowed = sorted(policy.allowed_listing_languages)
        for name in ("listing_language", "application_language"):
            code = F.col(f"_{name}")
            checks.append(F.when(code.isNull(), f"{name}_missing").when(~code.isin(*allowed), f"{name}_not_allowed"))
        codes = F.col("_codes")
        # by array functions, which are part of generated code, as filters over arrays are not
        checks.append(
            F.when(codes.isNull() | is_true(F.array_size(F.array_compact(codes)) < F.array_size(codes)), "required_languages_invalid").when(
                F.size(F.array_except(codes, F.array(*map(F.lit, allowed)))) > 0, "required_language_not_allowed"
            )
        )
    checks.append(F.when(F.col("_status") == "salary_invalid", F.col("_status")))
    hints = (F.when(~F.col("_dated"), F.lit("date_missing")), F.when(F.col("_status") != "salary_invalid", F.col("_status")))
    listed = lambda x: F.when(F.col(x) == "", F.array().cast("array<string>")).otherwise(F.split(x, ","))
    return (
        df.withColumns(parts)
        .withColumns({"_age": F.datediff(F.lit(today), F.col("_posted")), "_known": known, "_status": status})
        # joined and split again, which leaves out nulls inside generated code
        .withColumns({"_said": F.concat_ws(",", *checks), "_hints": F.concat_ws(",", *hints)})
        .select(
            *df.columns,
            F.struct((F.col("_said") == "").alias("pass"), listed("_said").alias("reasons"), listed("_hints").alias("warnings"), age.alias("age_days"), F.col("_known").alias("salary_known")).alias("gate"),
        )
    )


def score(age: Column) -> Column:
    """Sum of the fits and the recency points; null unless every fit is one of its steps."""
    fits = ((finite(F.col(c)), s) for c, s in (("core_fit", CORE_STEPS), ("evidence_fit", EVIDENCE_STEPS), ("workstyle_fit", WORKSTYLE_STEPS)))
    core, evidence, workstyle = (F.when(x.isin(*s), x) for x, s in fits)
    return core + evidence + workstyle + recency_points(age)


def qualified(df: DataFrame, today: date, policy: Policy) -> DataFrame:
    """Rows that pass the gate and the thresholds, with score; rows without a date are not ranked."""
    return (
        eligibility(df, today, policy)
        .where(F.col("gate.pass") & F.col("gate.age_days").isNotNull())
        .withColumn("score", score(F.col("gate.age_days")))
        .where((F.col("score") >= policy.min_output_score) & (F.col("core_fit") >= policy.min_core_fit) & (F.col("evidence_fit") >= policy.min_evidence_fit))
    )


def top_vacancies(df: DataFrame, today: date, policy: Policy) -> DataFrame:
    """The first qualified rows, known salaries before unknown ones."""
    url = F.coalesce(F.nullif(_has(df, "canonical_url", "string"), F.lit("")), _has(df, "url", "string"), F.lit(""))
    best = [F.desc("gate.salary_known"), F.desc("score"), F.desc("core_fit"), F.desc("evidence_fit"), F.col("gate.age_days"), url.desc()]
    return qualified(df, today, policy).orderBy(*best, F.coalesce(_has(df, "title", "string"), F.lit("")).desc()).limit(policy.max_output_roles)


#: Upper bounds and points.
FRESHNESS = ((1, 35), (6, 32), (24, 27), (72, 20), (168, 12), (720, 6))
ROUTES = {"employer": 25, "ats": 23, "job_board": 15, "other": 8}
COMPETITION = ((10, 20), (25, 17), (50, 13), (100, 8))
DEADLINE = ((72, 10), (168, 8), (336, 6))


def _steps(x: Column, steps: tuple[tuple[int, int], ...], beyond: int, unknown: int, name: str) -> Column:
    out = F.when(x.isNull(), unknown).when(x < 0, F.raise_error(F.lit(f"{name} must be >= 0")).cast("int"))
    for bound, points in steps:
        out = out.when(x <= bound, points)
    return out.otherwise(beyond)


def opportunity(age_hours: Column, route: Column, applicants: Column, deadline_hours: Column, verified: Column) -> Column:
    """struct of the five part scores, their sum and the warnings; independent of fit and eligibility."""
    routes = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[route]
    points = {
        "freshness_points": _steps(age_hours, FRESHNESS, 2, 8, "age_hours"),
        "route_points": F.coalesce(routes, F.raise_error(F.lit("unknown route type")).cast("int")),
        "competition_points": _steps(applicants, COMPETITION, 4, 8, "applicant_count"),
        "deadline_points": _steps(deadline_hours, DEADLINE, 4, 4, "deadline_hours"),
        "verification_points": F.when(verified, 10).otherwise(0),
    }
    total = sum(points.values(), F.lit(0))
    warnings = [F.when(x.isNull(), F.lit(w)) for x, w in ((age_hours, "freshness_unknown"), (applicants, "applicant_count_unknown"), (deadline_hours, "deadline_unknown"))]
    return F.struct(total.alias("score"), *[p.alias(n) for n, p in points.items()], F.array_compact(F.array(*warnings)).alias("warnings"))
