"""Text, URL and identifier rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that don't tell pages apart. Fixed values.
TRACKING = "^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src|cmpid|spm)(=|$)"
#: Query parameters of the accelerated form of a page. Fixed values.
AMP = "^(amp|outputtype|output|amp_js_v)(=|$)"


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` characters; a cut text ends in an ellipsis instead of trailing blanks."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or tracking parameters, sorted query, no trailing slash."""
    scheme = F.lower(F.regexp_extract(url, "^([^:/?#]+)://", 1))
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    path = F.when(F.rtrim(path, F.lit("/")) == "", "/").otherwise(F.rtrim(path, F.lit("/")))
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(scheme, F.lit("://"), host, path, tail)


def normalized_url(url: Column) -> Column:
    """Host without `www.` or `m.`, path without slashes at its end, sorted query without tracking or empty parameters; no scheme."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), r":\d+$", "")
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), "^m[.]", "")
    tracking = "^(utm_|fbclid=|gclid=|mc_|ref=|ref_src=|source=|cmpid=|ito=|at_)"
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1), "&"), lambda x: x.rlike("=.") & ~F.lower(x).rlike(tracking)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.rtrim(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit("/")), tail)


def dedup_url(url: Column) -> Column:
    """One spelling for the mobile, accelerated and plain forms of a page: its canonical URL as https, without what names the form."""
    canonical = canonical_url(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(canonical, "://([^/?#]*)", 1), "^(m|mobile|amp)[.]", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(canonical, "://[^/?#]*([^?#]*)", 1), "/amp/?$", ""), "^/amp/", "/")
    path = F.when(F.rtrim(path, F.lit("/")) == "", "/").otherwise(F.rtrim(path, F.lit("/")))
    kept = F.filter(F.split(F.regexp_extract(canonical, "[?](.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(AMP))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lit("https://"), host, path, tail)


def normal_text(text: Column) -> Column:
    """Lower case, links and @, # marks removed, each run of other than letters and digits one space."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), "[@#]", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def keyword_key(word: Column) -> Column:
    """A keyword without case, leading #, blanks, hyphens, underscores and middle dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(word)), "^#+", ""), "[ _·-]", "")


def placeholder(text: Column) -> Column:
    """True for texts without content: null, blank, punctuation only, one ASCII word, or hashtags only."""
    bare = F.trim(text)
    return F.coalesce(bare.rlike(r"^[\p{P}\p{S}\s]*$") | bare.rlike("^[A-Za-z0-9_.-]+$") | bare.rlike(r"^(#[^\s#]+\s*)+$"), F.lit(True))


#: A title's head and the tail that may be a site's name. Fixed value.
TAILED = r"^(.+?)\s+(?:\||-|–|—|:|::|·)\s+([^|:–—·-]{2,40})$"


def without_site(title: Column) -> Column:
    """A page's title without the site's name after the last bar or dash."""
    return F.trim(F.regexp_replace(title, r"\s+[|–—-]\s+[^|–—-]{1,40}$", ""))


def word_grams(words: Column, most: int) -> Column:
    """Distinct runs of one to `most` words."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        made = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, *[runs(n) for n in range(2, most + 1)]))


def stable_key(key: Column, most: int = 500) -> Column:
    """A key as it is, or its digest if it is longer than `most`."""
    return F.when(F.length(key) > most, F.concat(F.lit("sha256:"), F.sha2(key, 256))).otherwise(key)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


#: Character references that are decoded, the ampersand last. Fixed values.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Scripts, styles and tags removed, the commonest references decoded, blanks collapsed."""
    bare = F.regexp_replace(html, "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    bare = F.regexp_replace(bare, "(?s)<[^>]*>", " ")
    for reference, char in REFERENCES.items():
        bare = F.replace(bare, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def identifiers(text: Column) -> Column:
    """Emails and dotted addresses cited in a text, distinct and sorted, as kind:value."""
    emails = F.transform(F.regexp_extract_all(text, F.lit(r"([a-z0-9.]+@[a-z0-9]+\.[a-z0-9.]*[a-z])"), 1), lambda x: F.concat(F.lit("email:"), x))
    addresses = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"), 1), lambda x: F.concat(F.lit("ip:"), x))
    return F.array_sort(F.array_distinct(F.concat(emails, addresses)))
