"""The importer's own reading of the payloads: lead rows, request URLs, and the leads of web pages.

Its rules differ from the observations' (other fields, other URL form, stricter remoteness), so each provider is declared
anew. Leads are narrow rows: source_id, source_type, job_id, employer, title, url, published_hint, location, description,
note. Payloads are read in one pass per kind of payload.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import clean, is_true
from gleaner.functions.urls import let
from gleaner.operators import review
from gleaner.sources.pages import anchors, job_postings, page
from gleaner.sources.providers import _per_adapter, at, first, flag, name_of, text, texts

MOST_PER_SOURCE, MOST_POSTINGS, MOST_LINKS, MOST_ROWS = 250, 8, 5, 150
#: Listing paths, hosts whose root belongs to a tenant, and searches that take turns.
LISTING = r"^(?:/(?:careers?|jobs?|vacatures?|werken-bij|werkenbij|work-with-us|open-positions|openings|join-us|join-our-team|opportunities|about/careers?|company/careers?|career/openings|job-openings))(?:/(?:page/\d+|\d+))?$"
TENANT_HOSTS = ("jobs.lever.co", "jobs.eu.lever.co", "jobs.ashbyhq.com", "boards.greenhouse.io", "job-boards.greenhouse.io", "apply.workable.com")
QUERIES = (
    "remote WordPress WooCommerce developer jobs",
    "remote Elementor web designer Europe jobs",
    "fully remote frontend web developer WordPress",
    "remote website designer developer Netherlands worldwide",
)
LISTING_TITLE = r"\b(?:browse|more|search|find)\b.{0,45}\bjobs?\b|(?:remote[ -]?)?(?:wordpress|front[ -]?end|frontend|web[ -]?developer)\b.{0,35}\bjobs\b"
OTHER_WORK = r"\b(marketer|marketing|sales support|sales specialist|lending manager)\b"
ELSEWHERE = r"\b(remote[ -]?friendly|u\.?s\.?[ -]+based|usa[ -]+based|us only|usa only|uk only|w2 only)\b"
REMOTE_PLACE = r"\b(remote|telecommut)\b"
NOT_REMOTE = r"\b(hybrid|on[ -]?site|in.office|us only|usa only|united states only|uk only|w2 only)\b"
ROLE_LINK = r"\b(?:wordpress|woocommerce|elementor|gutenberg|web\s?design|web\s?develop|front.?end|website)\b"
WEB_ROLE, WEB_JOB = r"\b(?:wordpress|woocommerce|gutenberg|elementor|acf)\b", r"\b(?:developer|ontwikkelaar|engineer|specialist|support|designer|consultant|webmaster|administrator|beheerder|technician)\b"


# ---------------------------------------------------------------- URLs and identities
def lead_url(url: Column) -> Column:
    """https URL as the importer keeps it: no fragment, closing slash or tracking parameters; items in their order."""
    return let(F.regexp_replace(F.trim(url), "#.*$", ""), _lead_url)


def _lead_url(whole: Column) -> Column:
    host = F.lower(F.regexp_extract(whole, r"(?i)^https://([^/:?]+)", 1))
    bad = (host == "") | host.rlike(r"(?:^|\.)(?:localhost|local|internal)$") | host.rlike(r"^\d+\.\d+\.\d+\.\d+$") | whole.rlike(r"[\s\\<>\"'@]")
    head = F.regexp_replace(F.substring_index(whole, "?", 1), "/+$", "")
    items = F.filter(F.split(F.regexp_replace(whole, r"^[^?]*\??", ""), "&"), lambda i: (F.substring_index(i, "=", 1) != "") & ~F.lower(F.substring_index(i, "=", 1)).rlike("^utm_|^(?:fbclid|gclid|msclkid)$"))
    query = F.array_join(items, "&")
    return F.when(~bad, F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def shared_page(url: Column) -> Column:
    """Whether a URL is a list of roles: a careers path, a tenant's root, the root of a careers host."""
    return is_true(let(lead_url(url), lambda u: let(F.struct(F.lower(F.regexp_extract(u, r"(?i)^https://([^/?]+)", 1)).alias("host"), F.lower(F.regexp_replace(F.regexp_extract(u, r"(?i)^https://[^/?]+([^?]*)", 1), "/+$", "")).alias("path")), _listing)))


def _listing(x: Column) -> Column:
    host, path = x["host"], x["path"]
    return path.rlike(LISTING) | (host.isin(*TENANT_HOSTS) & path.rlike("^(/[^/]+)?$")) | (host.rlike(r"^(careers?|jobs?|werkenbij)\.") & (path == ""))


def role_identity(employer: Column, title: Column) -> Column:
    """employer::title in letters and digits; empty if one is missing."""
    e, t = (F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")) for x in (employer, title))
    return F.when((e != "") & (t != ""), F.concat_ws("::", e, t)).otherwise("")


def observation_key(adapter: Column, source: Column, job: Column, url: Column, employer: Column, title: Column) -> Column:
    """Key of a lead: by its id; on a shared page by id or URL together with the role, as one page lists many."""
    shared, role = shared_page(url), role_identity(employer, title)
    id_ = F.trim(F.coalesce(job, F.lit("")))
    explicit = F.when((id_ != "") & (id_ != url) & ~shared_page(id_), id_)
    by_role = F.concat(adapter, F.lit(":"), source, F.lit(":"), F.coalesce(explicit, lead_url(url)), F.lit(":role:"), F.substring(F.replace(F.url_encode(role), F.lit("+"), F.lit("%20")), 1, 350))
    return F.when(~shared & (id_ != ""), F.concat_ws(":", adapter, source, id_)).when(role != "", by_role).otherwise("")


def resolved(href: Column, base: Column) -> Column:
    """A page's link as a lead URL: search redirects unwrapped, paths put on the page's host."""
    v = F.trim(F.regexp_replace(href, "(?i)&amp;", "&"))
    target = F.when(v.rlike(r"(?i)^/url\?q="), F.try_url_decode(F.regexp_extract(v, "[?&]q=([^&]*)", 1))).otherwise(v)
    host = F.regexp_extract(base, "(?i)^(https://[^/]+)", 1)
    return let(target, lambda t: lead_url(F.when(t.rlike("^/(?!/)"), F.when(host != "", F.concat(host, t))).otherwise(t)))


def retry_at(header: Column, now_s: Column) -> Column:
    """Unix seconds after which to try again: now and a number of seconds, or an HTTP date ahead of now; else 0."""
    v = F.trim(F.coalesce(header, F.lit("")))
    day = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3}, (.*) GMT$", "$1 +0000"), F.lit("d MMM yyyy HH:mm:ss Z")).cast("double")
    return F.when(v.rlike(r"^\d+$"), now_s + v.try_cast("double")).when(day > now_s, day).otherwise(0.0)


def request_url(source_id: Column, url: Column, turn: Column, search_id: str = "google-jobs") -> Column:
    """Address to read of a public source; the search source takes one of its queries in turn."""
    asked = F.element_at(F.array(*map(F.lit, QUERIES)), (F.pmod(turn, F.lit(len(QUERIES))) + 1).cast("int"))
    search = F.concat(F.lit("https://www.google.com/search?q="), F.replace(F.url_encode(asked), F.lit("+"), F.lit("%20")), F.lit("&tbs=qdr:w"))
    host = F.regexp_extract(url, "(?i)^https://([^/:?#]+)", 1)
    safe = url.rlike(r"(?i)^https://[a-z0-9][a-z0-9.-]*/") & ~url.rlike(r"[\s\\<>\"'@]") & ~host.rlike(r"(?i)(?:^|\.)(?:localhost|local|internal)$") & ~host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return F.when(source_id == search_id, search).when(is_true(safe), url).otherwise("")


#: A provider's address with {} for the account, and the accounts that some are pinned to.
ADDRESSES = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=true",
    "lever": "https://api.lever.co/v0/postings/{}?mode=json&limit=100",
    "workable": "https://apply.workable.com/api/v1/widget/accounts/{}?details=true",
    "personio": "https://{}.jobs.personio.com/xml?language=en",
    "wordpressjobs": "https://jobs.wordpress.net/job_category/{}/feed/",
    "weworkremotely": "https://weworkremotely.com/categories/remote-programming-jobs.rss",
    "remoteok": "https://remoteok.com/api",
    "himalayas": "https://himalayas.app/jobs/api/search?q=wordpress&sort=recent&page=1",
    "jobicy": "https://jobicy.com/api/v2/remote-jobs?count=100&tag=wordpress",
    "remotive": "https://remotive.com/api/remote-jobs",
    "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{}/postings?limit=100&offset=0&destination=PUBLIC",
}
PINNED = {"wordpressjobs": ("development", "design"), "weworkremotely": ("programming",), **dict.fromkeys(("remoteok", "himalayas", "jobicy", "remotive"), ("global",))}
ONE_TENANT = {"source_id": "teamtailor", "account": "servebolt", "employer": "Servebolt", "endpoint": "https://careers.servebolt.com/jobs.rss", "registry_source_id": "company-servebolt"}


def spec_url(spec: DataFrame) -> Column:
    """Address of a spec (adapter, account, source_id, employer, endpoint, registry_source_id, api_region); empty if it has none."""
    account = F.col("account")
    made = {}
    for adapter, form in ADDRESSES.items():
        fits = account.isin(*PINNED[adapter]) if adapter in PINNED else F.lit(True)
        made[adapter] = F.when(fits, F.replace(F.lit(form), F.lit("{}"), account))
    made["lever"] = F.when(F.col("api_region") == "eu", F.replace(made["lever"], F.lit("//api."), F.lit("//api.eu."))).otherwise(made["lever"])
    one = F.lit(True)
    for column, value in ONE_TENANT.items():
        one = one & (F.col(column) == value)
    made["teamtailor"] = F.when(one, F.col("endpoint"))
    return F.coalesce(F.when(account.rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,80}$"), _per_adapter(made)), F.lit(""))


# ---------------------------------------------------------------- payloads
@dataclass(frozen=True)
class Feed:
    """Where a JSON provider's records are and how a lead's fields are read from one."""

    records: tuple[str, ...]
    title: Callable[[Column], Column]
    url: Callable[[Column], Column]
    job: Callable[[Column], Column]
    date: Callable[[Column], Column]
    place: Callable[[Column], Column]
    body: Callable[[Column], Column]
    note: str
    keep: Callable[[Column], Column] = lambda v: F.lit(True)


def _nothing(v: Column) -> Column:
    return F.lit("")


def _remote_only(v: Column) -> Column:
    return F.coalesce(F.lower(text(v, "$.workplaceType")) == "remote", F.lit(True))


def _workable_place(v: Column) -> Column:
    listed = F.array_join(F.filter(F.transform(F.coalesce(texts(v, "$.locations"), F.array().cast("array<variant>")), lambda i: first(i, "$.location_str", "$.country")), lambda x: x.isNotNull()), ", ")
    plain = F.nullif(F.concat_ws(", ", text(v, "$.city"), text(v, "$.country")), F.lit(""))
    place = F.coalesce(text(v, "$.location.location_str"), F.nullif(listed, F.lit("")), plain)
    return F.when(is_true(flag(v, "$.telecommuting")), F.concat_ws(" - ", F.lit("Remote"), place)).otherwise(place)


def _restrictions(v: Column) -> Column:
    return F.array_join(F.transform(texts(v, "$.locationRestrictions"), lambda r: F.coalesce(name_of(r), F.lit(""))), ", ")


def _or(f: Callable[[Column], Column], x: str) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(f(v), F.lit(x))


#: The notes are fixed values.
FEEDS = {
    "greenhouse": Feed(("$.jobs",), at("$.title"), at("$.absolute_url"), at("$.id"), at("$.first_published"), at("$.location.name"), at("$.content"), "ATS discovery; first_published when available"),
    "ashby": Feed(("$.jobs",), at("$.title"), at("$.jobUrl"), at("$.id"), at("$.publishedAt"), at("$.location"), at("$.descriptionPlain", "$.descriptionHtml"),
                  "Ashby publishedAt can mean republished; original date unverified", lambda v: _remote_only(v) & F.coalesce(flag(v, "$.isListed"), F.lit(True))),
    "lever": Feed(("$",), at("$.text"), at("$.hostedUrl"), at("$.id"), _nothing, at("$.categories.location"), at("$.descriptionPlain", "$.description"), "Lever createdAt is not original employer posting proof", _remote_only),
    "workable": Feed(("$.jobs",), at("$.title"), at("$.url", "$.shortlink"), at("$.id", "$.shortcode"), at("$.published_on"), _workable_place, at("$.description", "$.full_description"),
                     "Workable public listing; original date and NL eligibility still unverified"),
    "smartrecruiters": Feed(("$.content", "$.postings"), at("$.name", "$.title"), at("$.applyUrl"), at("$.id", "$.uuid"), at("$.releasedDate", "$.publicationDate"), at("$.location.city", "$.location.country"), _nothing,
                            "SmartRecruiters listing only; review exact official job link"),
    "remoteok": Feed(("$",), at("$.position"), at("$.apply_url", "$.url"), at("$.id"), at("$.date"), _or(at("$.location"), "Remote"), at("$.description"), "Remote OK aggregator: official employer role and date unverified"),
    "himalayas": Feed(("$.jobs",), at("$.title"), at("$.applicationLink"), at("$.guid"), at("$.pubDate"), _restrictions, at("$.description"), "Himalayas discovery only: provider date may differ from first publish"),
    "jobicy": Feed(("$.jobs",), at("$.jobTitle"), at("$.url"), at("$.id"), at("$.pubDate"), _or(at("$.jobGeo"), "Remote"), at("$.jobDescription"), "Jobicy discovery only: employer confirmation required"),
    "remotive": Feed(("$.jobs",), at("$.title"), at("$.url"), at("$.id"), at("$.publication_date"), _or(at("$.candidate_required_location"), "Remote"), at("$.description"), "Remotive delayed discovery feed, employer date unverified"),
}
XML_FEEDS = ("personio", "teamtailor", "wordpressjobs", "weworkremotely")
TEAMTAILOR_NOTE = "Employer Teamtailor feed; original date and NL eligibility still unverified"
XML_NOTE = "RSS/XML discovery date is not independently verified employer original"
_POSITIONS = "position array<struct<id:string,name:string,office:string,createdAt:string>>"
_ITEMS = "channel struct<item:array<struct<guid:string,title:string,link:string,pubDate:string,remoteStatus:string,description:string>>>"


def _shape(**said: Column) -> Column:
    return F.struct(*[F.coalesce(v.cast("string"), F.lit("")).alias(k) if k != "keep" else F.coalesce(v, F.lit(False)).alias(k) for k, v in said.items()])


def candidates(raw: DataFrame, most: int | None = MOST_PER_SOURCE) -> DataFrame:
    """Leads of raw payloads (source_id, source_type, adapter, account, employer, payload), of each payload's first `most` records (None: all)."""
    json = raw.where(F.col("adapter").isin(*FEEDS)).withColumn("v", F.try_parse_json("payload"))
    records = _per_adapter({a: F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in f.records]) for a, f in FEEDS.items()})
    lead = lambda f: _shape(keep=f.keep(F.col("rec")) & F.schema_of_variant("rec").startswith("OBJECT"), title=f.title(F.col("rec")), url=f.url(F.col("rec")), job=f.job(F.col("rec")), date=f.date(F.col("rec")), place=f.place(F.col("rec")), body=f.body(F.col("rec")), note=F.lit(f.note))
    rows = json.select("source_id", "source_type", "adapter", "account", "employer", F.posexplode(records).alias("pos", "rec")).withColumn("o", _per_adapter({a: lead(f) for a, f in FEEDS.items()})).drop("rec")
    rows = rows.unionByName(_xml(raw))
    url = lead_url(F.col("o.url"))
    out = rows.where((F.col("pos") < (most or 2**31 - 1)) & F.col("o.keep") & (F.col("o.title") != "")).withColumn("_url", url).where("_url is not null")
    return out.select(
        "source_id", "source_type", "adapter", F.concat_ws(":", "account", F.coalesce(F.nullif("o.job", F.lit("")), F.col("_url"))).alias("job_id"), F.coalesce(F.nullif("employer", F.lit("")), F.col("account")).alias("employer"),
        F.col("o.title").alias("title"), F.col("_url").alias("url"), F.col("o.date").alias("published_hint"), F.col("o.place").alias("location"), F.col("o.body").alias("description"), F.col("o.note").alias("note"),
        F.col("pos").alias("ordinal"),
    )


def _xml(raw: DataFrame) -> DataFrame:
    keep = ("source_id", "source_type", "adapter", "account", "employer")
    p = raw.where("adapter = 'personio'").withColumn("x", F.from_xml("payload", _POSITIONS, {"rowTag": "workzag-jobs", "mode": "PERMISSIVE"})).select(*keep, F.posexplode("x.position").alias("pos", "rec"))
    own = F.concat(F.lit("https://"), F.col("account"), F.lit(".jobs.personio.com/job/"), F.col("rec.id"))
    p = p.withColumn("o", _shape(keep=F.lit(True), title=F.col("rec.name"), url=own, job=F.col("rec.id"), date=F.col("rec.createdAt"), place=F.col("rec.office"), body=F.lit(""), note=F.lit(XML_NOTE)))
    safe = ~((F.col("adapter") == "teamtailor") & F.col("payload").rlike("(?i)<!DOCTYPE|<!ENTITY"))
    r = raw.where(F.col("adapter").isin(*XML_FEEDS[1:]) & safe).withColumn("x", F.from_xml("payload", _ITEMS, {"rowTag": "rss", "mode": "PERMISSIVE"})).select(*keep, F.posexplode("x.channel.item").alias("pos", "rec"))
    tenant, status = F.col("adapter") == "teamtailor", F.lower(F.trim(F.coalesce("rec.remoteStatus", F.lit(""))))
    number = F.regexp_extract("rec.link", r"(?i)^https://careers\.servebolt\.com/jobs/([1-9]\d*)-[a-z0-9-]+/?(?:[?#].*)?$", 1)
    fine = ~tenant | ((number != "") & ~status.rlike("^(hybrid|none|on[ -]?site|temporary)$"))
    place = F.when(tenant & status.rlike("^(fully|fully remote|remote)$"), "Remote").otherwise("")
    o = _shape(keep=fine, title=F.col("rec.title"), url=F.col("rec.link"), job=F.when(tenant, number).otherwise(F.col("rec.guid")), date=F.col("rec.pubDate"), place=place, body=F.col("rec.description"), note=F.when(tenant, TEAMTAILOR_NOTE).otherwise(XML_NOTE))
    return p.drop("rec").unionByName(r.withColumn("o", o).drop("rec"))


# ---------------------------------------------------------------- pages
def page_postings(pages: DataFrame) -> DataFrame:
    """Remote postings in a page's structured data: pages (source_id, source_type, source_name, url, html), at most `MOST_POSTINGS` a page."""
    read = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(job_postings(page(F.col("html"))["json_ld"])).alias("pos", "json")).withColumn("v", F.try_parse_json("json"))
    v = F.col("v")
    body = F.substring(F.coalesce(text(v, "$.description"), F.lit("")), 1, 4000)
    remote = F.coalesce(F.upper(text(v, "$.jobLocationType")).contains("TELECOMMUTE"), F.lit(False)) | body.rlike(r"(?i)\b(fully remote|100% remote|work from anywhere)\b")
    region = first(v, "$.applicantLocationRequirements[0].name", "$.applicantLocationRequirements[0].address.addressCountry", "$.applicantLocationRequirements.name", "$.applicantLocationRequirements.address.addressCountry")
    rows = read.select(
        "source_id", "source_type", F.substring(F.coalesce(text(v, "$.hiringOrganization.name"), F.col("source_name"), F.lit("")), 1, 150).alias("employer"), F.substring(text(v, "$.title"), 1, 180).alias("title"),
        resolved(text(v, "$.url"), F.col("url")).alias("link"), F.coalesce(text(v, "$.datePosted"), F.lit("")).alias("published_hint"), F.concat_ws(" - ", F.lit("Remote"), region).alias("location"), body.alias("description"),
        F.lit("Public JobPosting schema only; employer/ATS and NL eligibility unverified").alias("note"), remote.alias("_remote"), F.col("url").alias("_page"), "pos",
    ).where("link is not null and title is not null and _remote")
    return _capped(rows, MOST_POSTINGS)


def page_links(pages: DataFrame) -> DataFrame:
    """Links whose text names a role and remote work, at most `MOST_LINKS` a page; lists of roles and searches don't count."""
    read = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(anchors(F.col("html"))).alias("pos", "a")).withColumn("title", F.substring(clean(F.col("a.label")), 1, 180))
    read = read.where(F.col("title").rlike(r"(?i)\bremote\b") & F.col("title").rlike(f"(?i){ROLE_LINK}")).withColumn("link", resolved(F.col("a.href"), F.col("url")))
    rows = read.where(F.col("link").isNotNull() & ~F.col("link").rlike(r"(?i)^https://(?:www\.)?google\.") & ~shared_page(F.col("link"))).select(
        "source_id", "source_type", F.col("source_name").alias("employer"), "title", "link", F.lit("").alias("published_hint"), F.lit("Remote").alias("location"), F.lit("").alias("description"),
        F.lit("Remote link-text discovery only; official role/date/NL eligibility unverified").alias("note"), F.lit(True).alias("_remote"), F.col("url").alias("_page"), "pos",
    )
    return _capped(rows, MOST_LINKS)


def _capped(rows: DataFrame, most: int) -> DataFrame:
    seen = rows.withColumn("_r", F.row_number().over(W.partitionBy("source_id", "_page", "link").orderBy("pos"))).where("_r = 1")
    kept = seen.withColumn("_r", F.row_number().over(W.partitionBy("source_id", "_page").orderBy("pos"))).where(F.col("_r") <= most)
    return kept.select("source_id", "source_type", F.col("link").alias("job_id"), "employer", "title", F.col("link").alias("url"), "published_hint", "location", "description", "note", F.col("_r").alias("ordinal"))


def landing_links(pages: DataFrame, most: int = 25, read: int = 300) -> DataFrame:
    """Links of sources without an adapter whose text names both a role and a job; unverified observations."""
    from gleaner.functions.urls import canonical, role_specific
    from gleaner.operators.identity import safe_url

    a = pages.select("source_id", "source_type", "source_name", F.col("url").alias("_base"), F.posexplode(F.slice(anchors(F.substring("html", 1, 256 * 1024)), 1, read)).alias("pos", "a"))
    title = F.substring(clean(F.col("a.label")), 1, 180)
    href = F.col("a.href")
    host = F.regexp_extract("_base", "(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract("_base", r"(?i)^(https?://[^?#]*)", 1), "(?<=[^/])/[^/]*$", "")
    whole = F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat_ws("/", folder, href))
    a = a.withColumns({"title": title, "link": safe_url(whole)}).where(
        F.col("title").rlike(f"(?i){WEB_ROLE}") & F.col("title").rlike(f"(?i){WEB_JOB}") & ~href.rlike("^(#|javascript:|mailto:|data:)") & F.col("link").isNotNull() & (F.length("link") <= 2000)
    )
    a = a.where(role_specific(canonical(F.col("link"))))
    seen = a.withColumn("_r", F.row_number().over(W.partitionBy("source_id", "link").orderBy("pos"))).where("_r = 1")
    kept = seen.withColumn("ordinal", F.row_number().over(W.partitionBy("source_id").orderBy("pos"))).where(F.col("ordinal") <= most)
    return kept.select("source_id", F.lit("discovery").alias("source_type"), F.col("link").alias("canonical_url"), F.col("link").alias("url"), "title", F.when(F.col("source_type") == "employer_direct", F.col("source_name")).alias("employer"), "ordinal")


def fetch_outcome(status: Column, content_type: Column, size: Column, most: int = 256 * 1024) -> Column:
    """Failure of a landing page's fetch by its status, type and size; null if it can be read."""
    return (
        F.when(status.isNull(), "network_or_timeout").when(status.isin(401, 403), "authentication_or_access_required").when(status == 429, "rate_limited").when(status.between(300, 399), "redirect_not_followed")
        .when(status >= 500, "server_error").when(status >= 400, "http_client_error").when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "not_html").when(size > most, "page_too_large_for_safe_extract")
    )


def landing_scan(sources: DataFrame, covered: DataFrame, fetched: DataFrame, started_at: str) -> tuple[DataFrame, DataFrame]:
    """(attempts, observations) of the active sources that no adapter covers, from their fetched landing pages.

    sources: source_id, source_type, source_name, base_url, status; fetched: url, http_status, content_type, html.
    """
    open_ = sources.where("lower(trim(status)) = 'active'").join(covered.select("source_id").distinct(), "source_id", "left_anti")
    seen = open_.join(fetched.withColumnRenamed("url", "base_url"), "base_url", "left").withColumn("failure_category", fetch_outcome(F.col("http_status"), F.col("content_type"), F.length("html")))
    found = landing_links(seen.where("failure_category is null").withColumnRenamed("base_url", "url"))
    n = found.groupBy("source_id").agg(F.count("*").alias("candidate_links_unverified"))
    ok = F.col("failure_category").isNull()
    links = F.coalesce("candidate_links_unverified", F.lit(0))
    attempts = seen.join(n, "source_id", "left").select(
        F.concat(F.lit("web:"), "source_id").alias("source_instance"), F.array("source_id").alias("registry_source_ids"), F.lit(started_at).alias("started_at"), ok.alias("success"), links.alias("candidate_links_unverified"),
        "failure_category", F.when(~ok, "public_landing_probe_failed").when(links > 0, "public_html_job_link_discovery").otherwise("public_landing_probe_only").alias("attempt_kind"),
    )
    return attempts, found


# ---------------------------------------------------------------- known URLs and worker rows
def known_urls(*tables: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """url: what the register's tables know already, lists of roles left out."""
    out = None
    for table, columns in tables:
        for c in columns:
            one = table.select(lead_url(F.col(c)).alias("url"))
            out = one if out is None else out.union(one)
    return out.where(F.col("url").isNotNull() & ~shared_page(F.col("url"))).distinct()


def admitted_specs(specs: DataFrame, active: DataFrame) -> DataFrame:
    """Specs whose source, and whose employer's source if they name one, are active."""
    ids = active.select("source_id").distinct()
    return specs.join(ids, "source_id", "left_semi").join(ids.withColumnRenamed("source_id", "registry_source_id"), "registry_source_id", "left_semi").union(
        specs.where("registry_source_id is null").join(ids, "source_id", "left_semi").select("registry_source_id", *[c for c in specs.columns if c != "registry_source_id"])
    )


def worker_candidates(observations: DataFrame, sources: DataFrame, family: str, now_s: float, max_age_days: int = 7) -> DataFrame:
    """Leads of the worker's report, known or not: relevant and remote, with candidate_key and review status (_r).

    observations: ordinal, source_id, job_id, title, description, location, url, employer, published_hint, evidence,
    review_status; sources: source_id, source_type, source_name.
    """
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    o = observations.where((F.col("ordinal") < MOST_ROWS) & (F.col("review_status") == "unverified")).withColumns({"title": cut("title", 180), "description": cut("description", 800), "location": cut("location", 180), "url": lead_url(F.col("url"))})
    o = o.join(sources.select("source_id", "source_type", "source_name"), "source_id")
    low = lambda *c: F.lower(F.concat_ws(" ", *c))
    fine = (
        ~low("title").rlike(f"{LISTING_TITLE}|{OTHER_WORK}") & ~low("title", "location", "description").rlike(ELSEWHERE) & review.relevant(F.col("title"), F.col("description"), F.lit(family))
        & low("location").rlike(REMOTE_PLACE) & ~low("location", "description").rlike(NOT_REMOTE) & F.col("url").isNotNull()
    )
    employer = F.substring(F.coalesce(F.nullif("employer", F.lit("")), F.col("source_name"), F.lit("")), 1, 120)
    job = F.substring(F.coalesce(F.nullif("job_id", F.lit("")), F.col("url")), 1, 500)
    o = o.where(is_true(fine)).withColumns({"employer": employer, "job_id": job})
    o = o.withColumn("candidate_key", observation_key(F.lit("public_browser"), F.col("source_id"), F.col("job_id"), F.col("url"), F.col("employer"), F.col("title"))).where("candidate_key <> ''")
    o = o.withColumn("_r", review.lead_status(review.publication_seconds(F.col("published_hint")), F.col("location"), F.col("description"), F.lit(now_s), max_age_days))
    return o.where(~F.col("_r.status").isin("not_fully_remote_review", "geography_restricted_review"))


def worker_rows(observations: DataFrame, sources: DataFrame, known: DataFrame, old_keys: DataFrame, family: str, now_s: float, max_age_days: int = 7) -> DataFrame:
    """New leads of the worker's report: its candidates that are not known by url or candidate_key, each of these once."""
    return worker_new(worker_candidates(observations, sources, family, now_s, max_age_days), known, old_keys)


def worker_new(o: DataFrame, known: DataFrame, old_keys: DataFrame) -> DataFrame:
    """Rows for the leads' sheet of those candidates whose url (known) and candidate_key (old_keys) are new."""
    o = o.join(old_keys.select("candidate_key").distinct(), "candidate_key", "left_anti").join(known.select("url").distinct(), "url", "left_anti")
    for key in ("url", "candidate_key"):
        o = o.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ordinal"))).where("_n = 1").drop("_n")
    note = F.concat(F.lit("Public GitHub browser-worker: "), F.substring(F.coalesce("evidence", F.lit("public browser discovery")), 1, 180), F.lit("; "), F.col("_r.reason"))
    return o.select(
        "candidate_key", "source_id", "job_id", "employer", "title", F.col("url").alias("official_or_board_url"), F.substring(F.coalesce("published_hint", F.lit("")), 1, 40).alias("published_hint"), "location",
        F.col("_r.status").alias("review_status"), "source_type", note.alias("review_note"), "ordinal",
    )


def health_text(status: Column, last_success: Column, failures: Column) -> Column:
    """One line on a source's health for the register."""
    since = F.coalesce(F.concat(F.lit("last success "), last_success), F.lit("no success recorded"))
    return F.format_string("%s; %s; consecutive failures %d", F.coalesce(status, F.lit("unknown")), since, F.coalesce(failures, F.lit(0)))
