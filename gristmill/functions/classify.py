"""Answers classified: media type, status, challenge pages, dates, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of challenge pages, by vendor, in order of test (fixed values); none is in ordinary pages about the vendor.
CHALLENGES = (
    ("cloudflare", "cf-browser-verification"), ("cloudflare", "cf_chl_opt"), ("cloudflare", "just a moment..."), ("cloudflare", "checking your browser before accessing"),
    ("cloudflare", "attention required! | cloudflare"), ("cloudflare", "enable javascript and cookies to continue"), ("datadome", "captcha-delivery.com"), ("datadome", "datadome.co/customers-protection"),
    ("imperva", "_incapsula_resource"), ("imperva", "incapsula incident id"), ("perimeterx", "px-captcha"), ("perimeterx", "/_px/"), ("akamai", "akamaighost"), ("akamai", "errors.edgesuite.net"),
    ("sucuri", "sucuri website firewall"), ("aws waf", "captcha.awswaf.com"), ("aws waf", "awswaf-captcha"), ("generic", "ddos protection by"),
)
#: What an application shell has (fixed values).
APP_ROOTS = ("<noscript", "data-reactroot", "__next_data__", "ng-app", 'id="root"', 'id="app"', "id='root'")
SCAN_CHARS = 16_384
#: Leading bytes as hex, and what they mean (fixed values).
MAGICS = (("25504446", "pdf"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("504B0304", "archive"), ("1F8B", "archive"))


def essence(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def media(declared: Column, body: Column) -> Column:
    """``html``, ``xml``, ``json``, ``text``, a binary kind or ``unknown``: the body's first bytes decide before the declared type."""
    head = F.lower(F.ltrim(F.substring(body, 1, 1445)))
    code = F.hex(F.encode(F.substring(body, 1, 4), "UTF-8"))
    out = F.when(head.rlike("^<(!doctype html|html|head|body|title|meta|script|div|p|h1|table|a |!--)"), "html").when(head.startswith("<?xml"), "xml")
    for magic, kind in MAGICS:
        out = out.when(code.startswith(magic), kind)
    kind = essence(declared)
    return out.when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind.rlike(r"[/+]xml$"), "xml").when(kind.rlike(r"[/+]json$"), "json").when(kind.startswith("text/"), "text").otherwise("unknown")


def status_class(status: Column) -> Column:
    """What a fetch's status says of the page."""
    return (
        F.when(status == 304, "not_modified").when(status.between(200, 299), "ok").when(status == 410, "gone").when(status == 404, "not_found")
        .when(status == 429, "rate_limited").when(status.isin(401, 403), "blocked").when(status.between(500, 599), "server_error").otherwise("malformed")
    )


def challenge(body: Column, text_chars: Column) -> Column:
    """The vendor of a challenge page with under 200 characters of text, else null."""
    head = F.lower(F.substring(body, 1, SCAN_CHARS))
    out = F.lit(None).cast("string")
    for vendor, mark in reversed(CHALLENGES):
        out = F.when(head.contains(mark), vendor).otherwise(out)
    return F.when(text_chars < 200, out)


def is_shell(body: Column, text_chars: Column) -> Column:
    """A page that scripts fill: little text, over five scripts, an application root."""
    head = F.lower(F.substring(body, 1, SCAN_CHARS))
    root = F.lit(False)
    for mark in APP_ROOTS:
        root = root | head.contains(mark)
    return (text_chars < 500) & (F.regexp_count(head, F.lit("<script")) > 5) & root


def language_code(tag: Column) -> Column:
    """The primary subtag of two or three letters, lower-case; null for anything else."""
    first = F.lower(F.substring_index(F.regexp_replace(F.trim(tag), "_", "-"), "-", 1))
    return F.when(first.rlike("^[a-z]{2,3}$"), first)


def duration_ms(text: Column) -> Column:
    """``90s``, ``5m``, ``2h``, ``1d`` as milliseconds; null for anything else."""
    unit = F.create_map(*[F.lit(x) for kv in (("s", 1000), ("m", 60_000), ("h", 3_600_000), ("d", 86_400_000)) for x in kv])
    return F.when(text.rlike("^[0-9]{1,9}[smhd]$"), F.regexp_extract(text, "^([0-9]+)", 1).try_cast("long") * F.try_element_at(unit, F.substring(text, -1, 1)))


def retry_after_ms(value: Column) -> Column:
    """A Retry-After of seconds as milliseconds, at most a day."""
    seconds = value.try_cast("long")
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(86_400).cast("long")) * 1000)
