"""Identifiers, spellings and keys of titles, names and links as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an identifier of each kind looks like; the first group is its value. Fixed values.
REFS = {
    "arxiv": r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|huggingface\.co/papers/|arxiv:\s?)(\d{4}\.\d{4,5})",
    "doi": r"(?i)\b(10\.\d{4,9}/[^\s\"'<>()\[\],;]+)",
    "github": r"github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38})/[A-Za-z0-9_.-]{1,100})",
    "cve": r"(?i)\b(CVE-\d{4}-\d{4,7})\b",
    "3gpp": r"\b(?:3GPP\s+)?((?:TS|TR)\s?\d{2}\.\d{3})\b",
    "patent": r"\b(US\s?\d{4}/\d{7}|US\s?\d{1,2},?\d{3},?\d{3}|EP\s?\d{7}|WO\s?\d{4}/\d{6}|KR\s?10-\d{4}-\d{7})(?:\s?[ABUY]\d)?\b",
    "hf": r"huggingface\.co/([A-Za-z0-9][\w.-]{0,95}/[A-Za-z0-9][\w.-]{0,95})",
}
#: First path parts that are pages of the site and not owners. Fixed values.
RESERVED = {
    "github": "orgs settings features topics collections trending marketplace sponsors login about pricing security advisories apps search site".split(),
    "hf": "datasets spaces docs blog papers models collections learn join login".split(),
}
ARXIV_DOI = "10.48550/arxiv."
#: Words at the end of a company's name that say only its legal form. Fixed values.
FORMS = "inc incorporated corp corporation co company ltd limited llc plc gmbh ag sa nv bv holding holdings group".split()
#: Korean words of the same kind, and spellings of one loanword. Fixed values.
KOREAN_FORMS, KOREAN_VARIANTS = r"\(주\)|㈜|주식회사|(?<=\S)(그룹|홀딩스)$", {"브러더스": "브라더스"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once, however often `use` names it, also within the functions of arrays that it holds."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def references(text: Column) -> Column:
    """Distinct kind:value identifiers of a text, sorted: each kind in one spelling, arXiv DOIs as arXiv ids."""
    found = {kind: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1) for kind, pattern in REFS.items()}
    spell = {
        "doi": lambda x: F.lower(F.rtrim(x, F.lit("."))),
        "github": lambda x: F.lower(F.rtrim(F.regexp_replace(x, r"\.git$", ""), F.lit("."))),
        "cve": F.upper,
        "3gpp": lambda x: F.regexp_replace(F.upper(x), r"^(TS|TR)\s?", "$1 "),
        "patent": lambda x: F.upper(F.regexp_replace(x, r"[\s,]", "")),
        "hf": lambda x: F.lower(F.rtrim(x, F.lit("."))),
    }

    def named(kind: str, values: Column) -> Column:
        values = F.transform(values, spell.get(kind, lambda x: x))
        if kind in RESERVED:
            values = F.filter(values, lambda x: ~F.substring_index(x, "/", 1).isin(RESERVED[kind]) & ~x.endswith("/"))
        prefixed = lambda x: F.concat(F.lit(kind + ":"), x)
        if kind == "doi":
            return F.transform(values, lambda x: F.when(x.startswith(ARXIV_DOI), F.concat(F.lit("arxiv:"), F.substring(x, len(ARXIV_DOI) + 1, 1000))).otherwise(prefixed(x)))
        return F.transform(values, prefixed)

    parts = [named(kind, values) for kind, values in found.items()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def work_key(doi: Column) -> Column:
    """arxiv:<id> without its version for an arXiv DOI, else doi:<doi>, in lower case; null for none."""
    low = F.lower(F.trim(doi))
    arxiv = F.regexp_replace(F.substring(low, len(ARXIV_DOI) + 1, 1000), r"(.)v\d+$", "$1")
    return F.when(low.startswith(ARXIV_DOI), F.concat(F.lit("arxiv:"), arxiv)).when(low != "", F.concat(F.lit("doi:"), low))


def log_signature(message: Column) -> Column:
    """The first line of a message with links, hex runs and numbers masked, at most 180 characters."""
    line = F.substring_index(F.trim(message), "\n", 1)
    for pattern, mask in ((r"https?://\S+", "<url>"), (r"\b[0-9a-f]{8,}\b", "<hex>"), (r"\d+", "<n>")):
        line = F.regexp_replace(line, pattern, mask)
    return F.substring(F.trim(line), 1, 180)


def model_name(name: Column) -> Column:
    """Lower case, without what stands in parentheses, separators as single hyphens, no release date at the end."""
    low = F.lower(F.regexp_replace(F.trim(name), r"\([^)]*\)", " "))
    low = F.trim(F.regexp_replace(F.regexp_replace(low, r"[\s_./]+", "-"), "-{2,}", "-"), F.lit("-"))
    return F.regexp_replace(low, r"-(20\d{6}|\d{4}-\d{2}-\d{2})$", "")


def party_words(name: Column) -> Column:
    """A party's name as comparable words: lower case, no parentheses or punctuation, no legal forms at the end, bros as brothers."""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s*[(\[（][^)\]）]*[)\]）]", " ")
    low = F.regexp_replace(F.trim(low), KOREAN_FORMS, "")
    for variant, usual in KOREAN_VARIANTS.items():
        low = F.replace(low, F.lit(variant), F.lit(usual))
    words = F.filter(F.split(low, r"[\s,.'’`\"&!?/:;·_-]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.when(w == "bros", "brothers").otherwise(w))
    ends = lambda own: F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: (i == 1) | ~F.coalesce(F.get(own, i - 1), F.lit("")).isin(FORMS))
    return bound(words, lambda own: F.when(F.size(own) > 0, F.slice(own, F.lit(1), F.array_max(ends(own)))).otherwise(own))


def same_party(a: Column, b: Column) -> Column:
    """Two spellings of one party: equal once folded, or one is the leading words of the other (four letters at least)."""
    wa, wb = party_words(a), party_words(b)
    fa, fb = F.array_join(wa, ""), F.array_join(wb, "")
    heads = lambda x, y, fx: (F.size(x) <= F.size(y)) & (F.length(fx) >= 4) & (F.slice(y, F.lit(1), F.greatest(F.size(x), F.lit(0))) == x)
    return (fa != "") & (fb != "") & ((fa == fb) | heads(wa, wb, fa) | heads(wb, wa, fb))


def bare(text: Column) -> Column:
    """The letters, digits and underscores of a lower-cased text; empty for none."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def char_shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of `size` letters, digits and underscores of a lower-cased text, all else removed; a shorter text is one run.

    Takes time in proportion to the text: its characters are an array, and runs are that array beside itself, shifted.
    """

    def runs(chars: Column) -> Column:
        made = chars
        for shift in range(1, size):
            made = F.zip_with(made, F.slice(chars, F.lit(shift + 1), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
        short = F.filter(F.array(F.array_join(chars, "")), lambda x: x != "")
        return F.when(F.size(chars) < size, short).otherwise(F.array_distinct(F.slice(made, F.lit(1), F.greatest(F.size(chars) - (size - 1), F.lit(1)))))

    return bound(F.regexp_extract_all(bare(text), F.lit("(?s)(.)"), 1), runs)


#: Prime of the hash family, hashes in a signature, and rows in a band.
PRIME, HASHES, ROWS = 2_147_483_647, 64, 4
FAMILY = [((i + 1) * 1_000_003 % PRIME, (i + 7) * 998_244_353 % PRIME) for i in range(HASHES)]


def minhash(shingles: Column) -> Column:
    """The least value of each hash (a * x + b) mod PRIME over a set of shingles, x being 60 bits of MD5; empty for none."""
    base = F.transform(shingles, lambda s: F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long") % PRIME)
    family = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in FAMILY])
    least = lambda own: F.transform(family, lambda h: F.array_min(F.transform(own, lambda x: (x * h["a"] + h["b"]) % PRIME)))
    return bound(base, lambda own: F.when(F.size(own) > 0, least(own)).otherwise(F.array().cast("array<bigint>")))


def bands(signature: Column) -> Column:
    """One key for each band of ROWS values of a signature, with the band's number in it."""
    numbers = F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1))
    keys = F.transform(numbers, lambda i: F.concat(i.cast("string"), F.lit(":"), F.array_join(F.slice(signature, i * ROWS + 1, ROWS).cast("array<string>"), ",")))
    return F.when(F.size(signature) > 0, keys).otherwise(F.array().cast("array<string>"))


def agreement(a: Column, b: Column) -> Column:
    """The share of positions in which two signatures are equal."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(HASHES))
