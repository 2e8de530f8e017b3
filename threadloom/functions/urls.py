"""Links in message bodies as Column expressions: trimming, unwrapping, cleaning, denying and picking the ones to crawl."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: hosts, domains, path parts and file endings never crawled, labels of bulk mail, tracking parameters
DENIED_HOSTS = (
    "ct.sendgrid.net", "click.sendgrid.net", "links.sendgrid.net", "mail.google.com", "accounts.google.com", "goo.gl", "bit.ly", "t.co", "lnkd.in", "fb.me",
)
DENIED_HOST_STARTS = (
    "ablink.mail.", "click.", "click-", "clicks.", "ct.", "e.", "em.", "email.", "mailer.", "newsletter.", "enews.", "eventing.", "link.", "links.",
    "news.email.", "notifications.", "r.", "s2.", "sg.", "t.", "tracker.", "tracking.", "trk.", "view.",
)
DENIED_DOMAINS = (
    "list-manage.com", "hubspotlinks.com", "constantcontact.com", "email.salesforce.com", "rs6.net", "e2ma.net", "adlmail.org", "mkt.com", "sendgrid.net",
    "mailgun.net", "sparkpostmail.com", "salesforce-experience.com", "docs.google.com", "drive.google.com", "linkedin.com", "facebook.com", "twitter.com",
    "x.com", "instagram.com", "youtube.com", "youtu.be", "meet.google.com", "maps.google.com", "vimeo.com", "nextdoor.com",
)
DENIED_PATHS = (
    "unsubscribe", "optout", "opt-out", "opt_out", "manage-subscription", "manage_preferences", "email-preferences", "email_preferences", "preferences_center",
    "rsvp", "/accept", "/decline", "/respond", "action=respon", "action=rsvp", "action=accept", "action=decline", "/invitation", "/invite/", "calendar/event",
    "guest_response", "meeting_response", "approve", "/reject", "reject=", "/deny", "deny=", "answer=", "decision=", "response=yes", "response=no", "vote=",
    "confirm=", "/confirm/", "/login", "/signin", "/sign-in", "/sign_in", "/oauth", "/auth/", "/subscribe",
)
DENIED_ENDINGS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg", ".ico", ".mp4", ".mov", ".avi", ".mkv", ".mp3", ".wav", ".ogg", ".woff", ".woff2", ".ttf",
    ".otf", ".ics", ".zip", ".tar", ".gz", ".dmg", ".exe", ".apk",
)
BULK_LABELS = ("CATEGORY_PROMOTIONS", "CATEGORY_UPDATES", "CATEGORY_SOCIAL", "CATEGORY_FORUMS")
TRACKERS = (
    "gclid", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "twclid", "yclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "vero_id", "vero_conv",
    "oly_enc_id", "oly_anon_id", "ck_subscriber_id", "ml_subscriber", "ml_subscriber_hash", "_hsenc", "_hsmi", "hsctatracking", "s_cid", "ecid", "trk",
    "trkcampaign", "spmailingid", "spuserid", "spreportid", "cmpid", "recipient_id", "rb_clickid", "sc_customer", "ao_noindex",
)
TRACKER_STARTS = ("utm_", "oly_", "pk_", "piwik_", "matomo_", "ga_", "vero_")
BULK_CAP, HARD_CAP = 10, 50

_PUNCTUATION = r"""[.,;:!?"'>]+$"""


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def trimmed(url: Column) -> Column:
    """Without prose punctuation at the end, and without closing brackets that nothing opens."""

    def step(u: Column, _: Column) -> Column:
        less = F.expr("null").cast("string")
        for shut, opened in ((")", "("), ("]", "["), ("}", "{")):
            loose = u.endswith(shut) & (_count(u, opened) < _count(u, shut))
            less = F.coalesce(less, F.when(loose, F.substring(u, F.lit(1), F.length(u) - 1)))
        return F.when(u.rlike(_PUNCTUATION), F.regexp_replace(u, _PUNCTUATION, "")).otherwise(F.coalesce(less, u))

    # each step takes something off that run or changes nothing more
    ending = F.length(F.regexp_extract(url, r"""[.,;:!?"'>)\]}]+$""", 0))
    return F.when(ending > 0, F.aggregate(F.sequence(F.lit(1), ending), url, step)).otherwise(url)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter as it stands, or null."""
    found = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)
    return F.when(found != "", found)


def _plain(value: Column, plus: bool) -> Column:
    """Percent-decoded; ``plus`` stands for a space in query values only."""
    return F.try_url_decode(value if plus else F.replace(value, F.lit("+"), F.lit("%2B")))


def gateway_target(url: Column) -> Column:
    """Where a mail gateway's link leads, or null: its third form holds the link, its second an escaped parameter."""
    third = F.regexp_extract(url, r"/v3/__(.+?)__;", 1)
    second = _plain(F.translate(_plain(parameter(url, "u"), True), "-_", "%/"), False)
    inner = F.when(url.contains("/v3/__"), F.when(third != "", _plain(third, False))).otherwise(second)
    return F.when(host_of(url).contains("urldefense"), inner)


def redirect_target(url: Column) -> Column:
    """Where a known redirect leads by its query, or null; other sites' parameters are left alone."""
    host, safe = host_of(url), _plain(parameter(url, "url"), True)
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    searched = F.coalesce(_plain(parameter(url, "q"), True), safe)
    found = F.when(host.contains("safelinks.protection.outlook.com"), safe).when(host.endswith("google.com") & (path == "/url"), searched)
    return F.when(found.rlike("^https?://"), found)


def unwrapped(url: Column, hops: int = 3) -> Column:
    """The destination inside known wrappers, up to ``hops`` deep; other links as they are."""

    def step(u: Column, _: Column) -> Column:
        inner = F.coalesce(gateway_target(u), redirect_target(u))
        return F.when(u.rlike("^https?://") & inner.rlike("^https?://"), inner).otherwise(u)

    return F.aggregate(F.sequence(F.lit(1), F.lit(hops)), url, step)


def without_trackers(url: Column) -> Column:
    """Without tracking parameters; the others keep their order, and a link without any is untouched."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def tracks(pair: Column) -> Column:
        name = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
        out = name.isin(*TRACKERS)
        for x in TRACKER_STARTS:
            out = out | name.startswith(x)
        return out

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.array_join(F.filter(pairs, lambda p: ~tracks(p)), "&")
    base, rest = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    clean = F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), rest)
    return F.when(F.exists(pairs, tracks), clean).otherwise(url)


def host_denied(url: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Whether the host is denied by name, start or domain; ``blocked`` are more domains."""
    host = host_of(url)
    out = host.isin(*DENIED_HOSTS)
    for x in DENIED_HOST_STARTS:
        out = out | host.startswith(x)
    for x in (*DENIED_DOMAINS, *blocked):
        out = out | (host == x) | host.endswith(f".{x}")
    return out


def path_denied(url: Column) -> Column:
    """Whether path or query hold a part that acts (unsubscribing, answering, signing in)."""
    rest = F.lower(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^#]*)", 1))
    out = F.lit(False)
    for x in DENIED_PATHS:
        out = out | rest.contains(x)
    return out


def ending_denied(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1))
    out = F.lit(False)
    for x in DENIED_ENDINGS:
        out = out | path.endswith(x)
    return out


def crawl_denied(url: Column, blocked: tuple[str, ...] = ()) -> Column:
    return (host_of(url) == "") | host_denied(url, blocked) | path_denied(url) | ending_denied(url)


def looks_bulk(labels: Column) -> Column:
    return F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, BULK_LABELS))), F.lit(False))


def crawlable(body: Column, labels: Column, blocked: tuple[str, ...] = ()) -> Column:
    """The distinct links of a body worth crawling, in order; none of a body with too many (fewer are too many in bulk mail)."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0))
    clean = F.array_distinct(F.transform(F.filter(F.transform(found, trimmed), lambda u: u != ""), lambda u: without_trackers(unwrapped(u))))
    kept = F.filter(clean, lambda u: ~crawl_denied(u, blocked))
    many = (F.size(kept) > HARD_CAP) | (looks_bulk(labels) & (F.size(kept) > BULK_CAP))
    return F.when(many | body.isNull(), F.array().cast("array<string>")).otherwise(kept)


def stub_name(url: Column, most: int = 500) -> Column:
    """The file name a link is stored under until it has been crawled."""
    return F.substring(F.concat(F.lit("URL: "), url), 1, most)


def url_of_stub(name: Column) -> Column:
    found = F.regexp_extract(name, r"^URL: (https?://.*)$", 1)
    return F.when(found != "", found)


def drive_ids(body: Column) -> Column:
    """The distinct document ids (20 to 64 characters) in links to shared files, in order."""
    found = F.regexp_extract_all(body, F.lit(r"(?:docs|drive)\.google\.com/[^\s<>\"']*?(?:/d/|[?&]id=)([A-Za-z0-9_-]{20,64})(?![A-Za-z0-9_-])"), F.lit(1))
    return F.array_distinct(found)
