"""Scalar text functions as column expressions: URLs, titles, hashes, redaction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, hosts that redirect and the parameters with their target, names of known hosts, the host and paths that wrap others' articles, words that titles ignore.
TRACKING_PARAMS = ["_source", "campaign", "content", "fbclid", "gclid", "mc_cid", "mc_eid", "medium", "ref", "source", "term", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
REDIRECT_HOSTS = ["google.com", "news.google.com", "finance.yahoo.com", "l.facebook.com", "lnkd.in"]
REDIRECT_PARAMS = ["url", "u", "target"]
SOURCE_NAMES = {"reuters.com": "reuters", "bloomberg.com": "bloomberg", "wsj.com": "wsj", "cnbc.com": "cnbc", "marketwatch.com": "marketwatch", "finance.yahoo.com": "yahoo", "news.google.com": "google"}
WRAPPER_HOST, WRAPPER_PATHS = "news.google.com", ["/rss/articles/", "/articles/", "/read/"]
TITLE_STOPWORDS = ["a", "an", "and", "as", "at", "for", "from", "in", "of", "on", "the", "to", "with"]
# English stop words.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]
# The patterns that redaction masks. The two authorisation schemes are one pattern, as either is masked whole.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
KEY_VALUE = r"(?i)(password|passwd|pwd|secret|token|key|auth)['\"\s]*[:=]['\"\s]*([^\s'\"&<>]+)"
BEARER = r"(?i)(Bearer\s+[A-Za-z0-9\-_]{10,}|Basic\s+[A-Za-z0-9+/=]{10,})"
MASK = "[REDACTED]"
# The forms of API keys and access tokens.
KEY_FORMS = [r"sk-[A-Za-z0-9]{40,}", r"ghp_[A-Za-z0-9]{36}", r"gho_[A-Za-z0-9]{36}"]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def url_host(url) -> Column:
    """Lower-case host with port, without ``www.``, ``m.`` and the scheme's own port."""
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("https"))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")
    return F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def _params(url) -> Column:
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _one_canonical(url: Column) -> Column:
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("https"))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(_params(url), lambda p: ~name(p).isin(TRACKING_PARAMS))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(name(p).alias("n"), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.lit(1 << 20)).alias("v"), p.alias("p")))), lambda s: s["p"])
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/amp/?$", ""), r"\.amp$", ""), r"\.amp\.html$", ".html")
    query = let(F.array_join(ordered, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(scheme, F.lit("://"), url_host(url), let(path, lambda x: F.when(x == "", "/").otherwise(x)), query)


def _named(name: str):
    return lambda p: p.startswith(f"{name}=")


def _unwrapped(url: Column) -> Column:
    """The target of a redirect host's URL, else the URL."""
    found = [F.filter(_params(url), _named(k)) for k in REDIRECT_PARAMS]
    target = F.coalesce(*(F.nullif(F.try_url_decode(F.regexp_replace(F.get(x, F.lit(0)), "^[^=]*=", "")), F.lit("")) for x in found))
    return let(target, lambda t: F.when(url_host(url).isin(REDIRECT_HOSTS) & t.rlike(r"^https?://[^/?#]+"), t).otherwise(url))


def canonical_url(url, redirects: int = 2) -> Column:
    """Scheme and host lower-cased, prefixes, own ports, tracking parameters, fragments, AMP marks and
    trailing slashes gone, parameters sorted; known redirects unwrapped so many times. Empty for null."""
    url = F.trim(F.coalesce(col(url), F.lit("")))
    for _ in range(redirects):
        url = let(url, _unwrapped)
    return let(url, lambda u: F.when(u == "", "").otherwise(_one_canonical(u)))


SCHEME_AND_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def plain_url_key(url, drop: Iterable[str] = TRACKING_PARAMS) -> Column:
    """Scheme and host lower-cased, own ports, fragments and the parameters to ``drop`` gone, the others sorted; prefixes, paths and redirects stay."""
    url = F.trim(F.coalesce(col(url), F.lit("")))
    scheme, host = (F.lower(F.regexp_extract(url, SCHEME_AND_HOST, k)) for k in (1, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    pair = lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("n"), F.regexp_replace(p, "^[^=]*=?", "").alias("v"), F.substring_index(p, "=", 1).alias("k"))
    kept = F.array_sort(F.filter(F.transform(_params(url), pair), lambda p: ~p["n"].isin(list(drop))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.when(scheme == "", F.lower(url)).otherwise(F.concat(scheme, F.lit("://"), host, F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def source_name(url) -> Column:
    """The name of a URL's publisher: a known host's, else the host's first label; ``unknown`` without a host."""
    host = F.replace(F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), SCHEME_AND_HOST, 2)), F.lit("www."), F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in SOURCE_NAMES.items() for x in pair))
    return F.when(host == "", "unknown").otherwise(F.coalesce(F.element_at(names, host), F.split(host, r"\.")[0]))


def url_class(url) -> Column:
    """Whether a URL is a wrapper of another's article, a publisher's own, or neither."""
    url = F.coalesce(col(url), F.lit(""))
    scheme, host = (F.lower(F.regexp_extract(url, SCHEME_AND_HOST, k)) for k in (1, 2))
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    wrapped = (host == WRAPPER_HOST) & F.array_contains(F.transform(F.array(*map(F.lit, WRAPPER_PATHS)), lambda p: F.startswith(path, p)), True)
    return F.when(~scheme.isin("http", "https") | (host == ""), "unsupported").when(wrapped, "wrapper").otherwise("direct_publisher")


def normalized_title(title) -> Column:
    """Lower case; what is no letter or digit becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def title_tokens(normalized) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: (t != "") & ~t.isin(TITLE_STOPWORDS)))


def jaccard(a, b) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a, b) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def article_id(url) -> Column:
    return F.concat(F.lit("art_"), F.substring(F.sha2(url, 256), 1, 16))


def md5_bucket(key, buckets: int = 100) -> Column:
    """The md5 of a key as a 128-bit number modulo ``buckets``, by its two halves' digits."""
    digest, value = F.md5(F.coalesce(key, F.lit(""))), F.lit(0).cast("long")
    for k in range(8):
        value = (value * 65536 + F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("long")) % buckets
    return value.cast("int")


def words(text) -> Column:
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")


def text_counts(text) -> dict[str, Column]:
    text = F.coalesce(col(text), F.lit(""))
    return {"n_words": F.size(words(text)), "n_sentences": F.regexp_count(text, F.lit(r"[.!?]+")), "n_paragraphs": F.size(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")), "n_numbers": F.regexp_count(text, F.lit(r"\d+"))}


def quote_count(text) -> Column:
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit('"[^"]*"'))


def readability_band(ease: Column) -> Column:
    """A reading-ease score of 0 to 100 as 0 to 1: best from 60 to 70, less the farther from there."""
    return F.when(ease <= 0, 0.0).when((ease >= 100) | ease.between(60, 70), 1.0).when(ease.between(40, 80), 0.8).when(ease.between(20, 90), 0.6).otherwise(0.4)


def best_sentence(text, terms: Iterable[str]) -> Column:
    """The sentence with most terms, then most characters (240 count), the first of equals."""
    sentences = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")
    hits = lambda s: F.size(F.array_intersect(F.split(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "), " "), F.array(*map(F.lit, terms))))
    scored = F.transform(sentences, lambda s, i: F.struct(hits(s).alias("n"), F.least(F.length(s), F.lit(240)).alias("l"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def redacted(text) -> Column:
    """E-mail addresses and secrets masked; the name of a secret stays."""
    text = F.regexp_replace(F.coalesce(col(text), F.lit("")), EMAIL, MASK)
    return F.regexp_replace(F.regexp_replace(text, BEARER, MASK), KEY_VALUE, f"$1={MASK}")


def redacted_secrets(text) -> Column:
    """As ``redacted``, with API keys and access tokens that stand by themselves masked too."""
    text = redacted(text)
    for form in KEY_FORMS:
        text = F.regexp_replace(text, form, MASK)
    return text


def redacted_map(values, names: Iterable[str]) -> Column:
    """A map whose values under sensitive names are masked."""
    listed = list(names)
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(listed), F.lit(MASK)).otherwise(v))


def lexicon_sentiment(text, positive: list[str], negative: list[str]) -> tuple[Column, Column]:
    """(score, confidence): distinct positive minus negative words, a third each, clamped to -1..1."""
    tokens = F.transform(words(F.lower(F.coalesce(col(text), F.lit("")))), lambda w: F.regexp_replace(w, r"^[.,:;!?]+|[.,:;!?]+$", ""))
    n = lambda terms: F.size(F.array_intersect(tokens, F.array(*map(F.lit, terms))))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n(positive) - n(negative)) / F.lit(3.0)))
    return score, F.least(F.lit(1.0), 0.5 + F.abs(score) / 2)


def text_basis(full_text, snippet, title) -> tuple[Column, Column]:
    """(text, basis): the fullest text there is."""
    there = [F.nullif(F.trim(col(c)), F.lit("")) for c in (full_text, snippet, title)]
    return F.coalesce(*there), F.when(there[0].isNotNull(), "full_text").when(there[1].isNotNull(), "snippet").otherwise("title")


def numeric_facts(text) -> dict[str, Column]:
    """All prices, percentages and amounts of a text."""
    text = F.coalesce(col(text), F.lit(""))
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return {"prices": found(r"\$(\d+(?:\.\d+)?)"), "percentages": found(r"(\d+(?:\.\d+)?)\s?%"), "large_amounts": found(r"(\d+(?:\.\d+)?)\s?(?:million|billion|trillion)")}


def term_hits(text, terms: dict[str, str]) -> Column:
    """Names whose pattern occurs in the text, in the order given."""
    return F.filter(F.array(*(F.when(F.coalesce(col(text), F.lit("")).rlike(p), F.lit(n)) for n, p in terms.items())), lambda x: x.isNotNull())
