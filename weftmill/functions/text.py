"""Text scalars as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts that count as content besides ASCII letters and digits, as ranges of code points, and the punctuation marks that count.
CONTENT = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))
CONTENT_CLASS = "[^0-9A-Za-z" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in CONTENT) + "]"
PUNCTUATION = "[,，.。;；]"
# Host parts that say nothing about a site, and page marks of an access check.
GENERIC_HOST = "www m wap app blog html php asp aspx jsp cgi com org net edu gov io co us uk cc top xyz vip club site online store dev test localhost 127 0".split()
#: Marks of a page whose script runs an access check.
SCRIPT_CHALLENGE = [r'let token = "[^"]+"', r"window\.location\.href.*challenge", "請稍等，正在進行安全驗證", "正在验证浏览器"]
CHALLENGE = [
    "cf-browser-verification", "challenge-platform", "jschl-answer", "cf_chl_opt", "cdn-cgi/challenge", "Just a moment", "Checking your browser before", "Attention Required",
    "cf-turnstile", "__cf_bm", "cf_clearance", "hcaptcha", "g-recaptcha", "geetest", "imperva", "_Incapsula_Resource", "403 Forbidden", "Access Denied", "Bot Detection",
    "安全验证", "人机验证", "访问频繁", "请稍后重试",
]
AUTHOR_NOTES = ["author's note", "author note", "a/n", "author:", "作者的话", "作者说", "作者有话说", "译者的话", "ps.", "p.s.", "note:", "notes:"]


def closed_references(html: Column) -> Column:
    """html in which only a reference that ends in its semicolon is one, as in XML; any other ampersand stands for itself.

    A parser of HTML reads "&amp" without a semicolon as "&"; in what this gives it is four characters.
    """
    return F.regexp_replace(html, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[Xx][0-9A-Fa-f]+);)", "&amp;")


def norm(c: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def scoring_length(c: Column) -> Column:
    """Letters and numbers of any script."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def content_chars(c: Column) -> Column:
    """ASCII letters and digits, kana, Han and hangul; accented Latin letters don't count."""
    return F.length(F.regexp_replace(c, CONTENT_CLASS, ""))


def punctuation_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PUNCTUATION))


def relevance(query: str, title: Column) -> Column:
    """1 minus the relative difference in length where the title holds the query, else 0.5 (also for two empty strings: 1)."""
    n, m = F.lit(len(query)), F.length(title)
    hit = F.contains(F.lower(title), F.lit(query.lower()))
    return F.when(hit, F.when(F.greatest(n, m) == 0, 1.0).otherwise(1 - F.abs(n - m) / F.greatest(n, m))).otherwise(0.5)


def safe_filename(c: Column, most: int = 50) -> Column:
    """Characters that file systems refuse become underscores (the ASCII question mark too), cut to `most`."""
    return F.substring(F.regexp_replace(c, r'[<>:"/\\|?？*]', "_"), 1, most)


def preview(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" ..."))).otherwise(c)


def strip_label(c: Column, *labels: str) -> Column:
    for label in labels:
        c = F.replace(c, F.lit(label), F.lit(""))
    return F.trim(c)


def host(url: Column) -> Column:
    """Lower-cased authority of a URL, with port and user part."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host_tokens(url: Column) -> Column:
    """Parts of the host longer than two characters that are not generic."""
    generic = F.array(*[F.lit(x) for x in GENERIC_HOST])
    return F.filter(F.split(host(url), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~F.array_contains(generic, t))


def resolved_path(path: Column) -> Column:
    """A path without dot segments: '..' takes the segment before it away, a last dot segment leaves a slash."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    held = F.aggregate(parts, none, lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x))))
    out = F.array_join(F.concat(held, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def absolute_url(base: Column, href: Column) -> Column:
    """href against a base page: whole, scheme-relative, host-relative, query or fragment alone, or relative to the base's folder; paths that are put together or start at the host lose their dot segments."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(F.substr(page, F.length(root) + 1), r"[^/]*$", "")
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.substr(href, F.length(path) + 1)
    return (
        F.when(F.trim(href) == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, resolved_path(path), rest))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, resolved_path(F.regexp_replace(F.concat(F.lit("/"), folder, path), "/{2,}", "/")), rest))
    )


def is_challenge(html: Column, status: Column | None = None) -> Column:
    """A page that an access check sent instead of the content: by status or by marks in its first 15,000 characters."""
    found = F.coalesce(F.substring(html, 1, 15_000).rlike("(?iu)" + "|".join(CHALLENGE)), F.lit(False))
    return found if status is None else found | F.coalesce(status.isin(403, 429, 503), F.lit(False))


def is_script_challenge(html: Column) -> Column:
    """A page whose script runs an access check, by marks anywhere in it; false for null."""
    return F.coalesce(html.rlike("(?iud)" + "|".join(SCRIPT_CHALLENGE)), F.lit(False))


def has_author_note(c: Column, compat: bool = False) -> Column:
    """A paragraph that starts an author's note. The marks `ps.` and `a/n` have to stand alone, unless compat."""
    low = F.lower(c)
    marks = [low.contains(m) if compat or m not in ("ps.", "a/n") else low.rlike(r"(^|[^\p{L}\p{N}])" + m.replace(".", r"\.")) for m in AUTHOR_NOTES]
    out = marks[0]
    for m in marks[1:]:
        out = out | m
    return out


def strip_leading_title(text: Column, title: Column) -> Column:
    """text without the title in front of it and the separators after that."""
    rest = F.substr(text, F.length(title) + 1)
    return F.when((F.length(title) > 0) & F.startswith(text, title), F.regexp_replace(rest, r"^[\s:：\-–—|.、]+", "")).otherwise(text)
