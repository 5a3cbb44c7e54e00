"""Column functions on URLs. Hosts and paths are cut out by pattern, so that odd hosts behave alike everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRACKING_KEYS = ("fbclid", "gclid", "msclkid")
GENERIC_LAST = (
    "career", "careers", "get-hired", "job", "jobs", "open-positions", "openings", "opportunities", "remote-jobs",
    "search", "vacancies", "vacature", "vacatures", "werken-bij", "work-with-us",
)
GENERIC_MARKERS = ("categories", "category", "search", "tag")
APPLY_LAST = ("apply", "application")
APPLY_KEYS = ("gh_jid", "id", "job", "job_id", "jobid", "position", "posting")
#: Hosts whose first path segment is the employer's account, and hosts that have it as a subdomain.
ACCOUNT_IN_PATH = {
    "boards.greenhouse.io": "greenhouse",
    "job-boards.greenhouse.io": "greenhouse",
    "job-boards.eu.greenhouse.io": "greenhouse",
    "jobs.ashbyhq.com": "ashby",
    "jobs.lever.co": "lever",
    "jobs.eu.lever.co": "lever",
    "careers.smartrecruiters.com": "smartrecruiters",
    "jobs.smartrecruiters.com": "smartrecruiters",
    "apply.workable.com": "workable",
}
ACCOUNT_IN_HOST = {
    ".jobs.personio.de": "personio",
    ".jobs.personio.com": "personio",
    ".recruitee.com": "recruitee",
    ".teamtailor.com": "teamtailor",
    ".workable.com": "workable",
    ".bamboohr.com": "bamboohr",
}

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: nested uses of a long expression would multiply."""
    return F.transform(F.array(x), f)[0]


def parts(url: Column) -> dict[str, Column]:
    u = F.trim(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))
    authority = F.regexp_replace(F.regexp_extract(u, _URL, 2), "^.*@", "")
    return {
        "scheme": F.lower(F.regexp_extract(u, _URL, 1)),
        "host": F.lower(F.regexp_replace(authority, r":[^:\]]*$", "")),
        "port": F.regexp_extract(authority, r":([^:\]]*)$", 1),
        "path": F.regexp_extract(u, _URL, 3),
        "query": F.regexp_extract(u, _URL, 4),
    }


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """Form encoding that leaves the tilde and escapes the asterisk."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical(url: Column, sort_query: bool = True, https_only: bool = False) -> Column:
    """HTTP(S) URL with lower-case host, without default port, user, fragment, closing slashes and tracking keys.

    Query items are decoded, put in order and encoded again. Null for other schemes, empty hosts and bad ports.
    """
    p = parts(url)
    good_port = p["port"].rlike(r"^\d{0,5}$") & (F.coalesce(p["port"].try_cast("int"), F.lit(0)) <= 65535)
    port = F.regexp_replace(p["port"], "^0+(?=.)", "")
    default = (port == "") | ((p["scheme"] == "http") & (port == "80")) | ((p["scheme"] == "https") & (port == "443"))
    site = F.when(default, p["host"]).otherwise(F.concat(p["host"], F.lit(":"), port))
    path = F.when(p["path"].rlike("^/*$"), F.lit("/")).otherwise(F.regexp_replace(p["path"], "/+$", ""))

    def item(i: Column) -> Column:
        key = _decoded(F.substring_index(i, "=", 1))
        value = F.when(i.contains("="), _decoded(F.substr(i, F.instr(i, "=") + 1))).otherwise("")
        return F.struct(key.alias("k"), value.alias("v"))

    items = F.transform(F.filter(F.split(p["query"], "&"), lambda i: i != ""), item)
    items = F.filter(items, lambda i: ~(F.lower(i["k"]).startswith("utm_") | F.lower(i["k"]).isin(*TRACKING_KEYS)))
    items = F.array_sort(items) if sort_query else items
    query = F.array_join(F.transform(items, lambda i: F.concat(_encoded(i["k"]), F.lit("="), _encoded(i["v"]))), "&")
    schemes = ("https",) if https_only else ("http", "https")
    return F.when(
        p["scheme"].isin(*schemes) & (p["host"] != "") & good_port,
        F.concat(p["scheme"], F.lit("://"), site, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")),
    )


def role_specific(canonical_url: Column) -> Column:
    """Whether a canonical URL names one posting, not a careers, list, search, tag or further page."""
    p = parts(canonical_url)
    seg = F.filter(F.split(F.lower(p["path"]), "/"), lambda s: s != "")
    last = F.try_element_at(seg, F.lit(-1))
    paged = (F.try_element_at(seg, F.lit(-2)) == "page") & last.rlike("^[0-9]+$")
    keyed = F.exists(
        F.split(p["query"], "&"), lambda i: F.lower(F.substring_index(i, "=", 1)).isin(*APPLY_KEYS) & i.contains("=") & ~i.endswith("=")
    )
    return F.coalesce(
        (F.size(seg) > 0)
        & ~F.arrays_overlap(seg, F.array(*map(F.lit, GENERIC_MARKERS)))
        & ~F.coalesce(paged, F.lit(False))
        & ~last.isin(*GENERIC_LAST)
        & (~last.isin(*APPLY_LAST) | keyed),
        F.lit(False),
    )


def ats(url: Column) -> Column:
    """struct(provider, account) of an applicant system's URL; null for other hosts."""
    p = parts(url)
    first = F.try_element_at(F.filter(F.split(p["path"], "/"), lambda s: s != ""), F.lit(1))
    by_path = F.create_map(*[F.lit(t) for kv in ACCOUNT_IN_PATH.items() for t in kv])[p["host"]]
    out = F.when(by_path.isNotNull() & first.isNotNull(), F.struct(by_path.alias("provider"), first.alias("account")))
    for suffix, provider in ACCOUNT_IN_HOST.items():
        account = F.regexp_extract(p["host"], rf"^([a-z0-9-]+){suffix.replace('.', chr(92) + '.')}$", 1)
        out = out.when(by_path.isNull() & (account != ""), F.struct(F.lit(provider).alias("provider"), account.alias("account")))
    return F.when(p["scheme"].isin("http", "https"), out)
