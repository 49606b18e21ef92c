"""Scalar logic on text, URLs, dates and JSON as columns: no Python on the data path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with costly columns that are computed once a row: filters on them are not pushed below (which would compute them twice) and
    later columns do not repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


#: the space separators of Unicode (category Zs)
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim(x: Column | str) -> Column:
    """x without space separators at its ends (no-break and ideographic ones too; tabs and line ends stay)."""
    return F.trim(_c(x), F.lit(SPACES))


def effective_text(*candidates: Column | str) -> Column:
    """The first candidate that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in candidates), F.lit(""))


def cache_key(url: Column | str) -> Column:
    return F.md5(_c(url).cast("binary"))


def url_host(url: Column | str) -> Column:
    """Host (with user and port as written), www. removed wherever it stands."""
    authority = F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.replace(authority, F.lit("www."), F.lit(""))


def source_domain(url: Column | str) -> Column:
    return F.rtrim(F.regexp_replace(_c(url), "^https?://", ""), F.lit("/"))


def slug(x: Column | str, sep: str = "-", size: int = 50) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", sep), F.lit(sep)), F.lit(size))


def truncated(x: Column | str, size: int = 60) -> Column:
    return F.when(F.length(_c(x)) > size, F.concat(F.left(_c(x), F.lit(size)), F.lit("..."))).otherwise(_c(x))


def html_escape(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_to_text(x: Column | str, cap: int = 5000, least: int = 100) -> Column:
    """Scripts and styles dropped, tags stripped, white space squeezed; null under least characters."""
    out = F.regexp_replace(_c(x), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"[ \t\r\n]+", " "))
    return F.when(F.length(out) >= least, F.left(out, F.lit(cap)))


def words(x: Column | str) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(_c(x), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


#: an abbreviation of single letters with full stops, a run of letters or digits, or any other character but white space
TOKEN = r"(?:\p{L}\.){2,}|[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"


def tokens(x: Column | str) -> Column:
    """Lowered tokens: u.s. is one, each punctuation mark is one."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), F.lit(0))


def phrase_starts(words: str, phrases: Sequence[str]) -> Column:
    """Places, counted from 0, of the array column words at which one of the phrases (tokens joined by one space) begins, each once.
    Words are looked up in the phrases' first words; only where one fits are as many words joined as the phrases have."""
    by_size: dict[int, list[str]] = {}
    for p in phrases:
        by_size.setdefault(len(p.split()), []).append(" ".join(p.lower().split()))

    def begins(w: Column, i: Column) -> Column:
        out = F.lit(False)
        for n, same in sorted(by_size.items()):
            found = w.isin(*same) if n == 1 else w.isin(*{p.split()[0] for p in same}) & F.array_join(F.slice(words, i + 1, n), " ").isin(*same)
            out = out | found
        return out

    return F.filter(F.transform(words, lambda w, i: F.when(begins(w, i), i)), lambda i: i.isNotNull())


#: a run of the digits 0-9 with no ASCII letter, digit or underscore beside it
NUMBER = r"(?<![0-9A-Za-z_])[0-9]+(?![0-9A-Za-z_])"


def number_count(x: Column | str) -> Column:
    """How many numbers x holds.  Borders are those of ASCII words, so letters such as é and marks may touch a number."""
    return F.regexp_count(_c(x), F.lit(NUMBER))


def paragraphs(x: Column | str, least: int = 30) -> Column:
    return F.filter(F.transform(F.split(_c(x), "\n"), trim), lambda p: F.length(p) > least)


def sentences(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), r"[.!?]+[ \n]+"), lambda s: s != "")


def any_term(x: Column | str, terms: Sequence[str]) -> Column:
    """Is any of the terms a substring of the lowered text?"""
    text = F.lower(_c(x))
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t.lower())
    return out


def first_class(x: Column | str, classes: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """Name of the first class of which a term occurs."""
    out = F.lit(other)
    for name, terms in reversed(classes):
        out = F.when(any_term(x, terms), name).otherwise(out)
    return out


def quoted_spans(x: Column | str, least: int = 20) -> Column:
    return F.filter(F.regexp_extract_all(_c(x), F.lit('["“]([^"“”]*)["”]'), F.lit(1)), lambda s: F.length(s) >= least)


def original_terms(x: Column | str) -> Column:
    """Quoted terms of 2 to 40 characters, capitalised multi-word names, Arabic and CJK runs; first appearance order, capped 8/10/10/15."""
    take = lambda pattern, n, g=0: F.slice(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(g))), 1, n)
    quoted = take('["“«]([^"“”«»]{2,40})["”»]', 8, 1)
    names = take(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", 10)
    arabic = take("[؀-ۿ]{3,}(?: [؀-ۿ]{3,})*", 10)
    cjk = take("[一-鿿]{2,}", 15)
    return F.array_distinct(F.concat(quoted, names, arabic, cjk))


def keyword_tokens(x: Column | str, stop: Sequence[str], least: int = 4) -> Column:
    """Tokens of at least least characters, punctuation stripped after the length test, without stop words."""
    long = F.filter(words(F.lower(_c(x))), lambda w: F.length(w) >= least)
    bare = F.transform(long, lambda w: F.trim(w, F.lit(".,;:!?\"'()[]{}|*$%&#")))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(*stop))


def parse_date(x: Column | str) -> Column:
    """yyyyMMddHHmmss, then yyyyMMdd, then yyyy-MM-dd prefixes (a T and Z may stand between), else null."""
    bare = F.replace(F.replace(_c(x), F.lit("T"), F.lit("")), F.lit("Z"), F.lit(""))
    tries = [(bare, 14, "yyyyMMddHHmmss"), (bare, 8, "yyyyMMdd"), (_c(x), 10, "yyyy-MM-dd")]
    return F.coalesce(*(F.try_to_timestamp(F.left(v, F.lit(n)), F.lit(f)).cast("date") for v, n, f in tries))


def compact_timestamp(x: Column | str) -> Column:
    """yyyyMMddHHmmss; what cannot be read keeps its characters but - : and space, 14 at most."""
    read = F.date_format(F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd HH:mm:ss")), "yyyyMMddHHmmss")
    return F.coalesce(read, F.left(F.translate(_c(x), "-: ", ""), F.lit(14)))


def duration_seconds(x: Column | str) -> Column:
    """H:M:S, M:S or seconds; null if anything else."""
    parts = F.transform(F.split(F.trim(_c(x)), ":"), lambda p: F.expr("1") * p.try_cast("int"))
    n = F.size(parts)
    get = lambda i: F.get(parts, F.lit(i))
    return F.when(n == 3, get(0) * 3600 + get(1) * 60 + get(2)).when(n == 2, get(0) * 60 + get(1)).when(n == 1, get(0))


def dated(x: Column | str, pattern: str) -> Column:
    """A date in a pattern that begins with the year; years beyond 9999 have no sign."""
    return F.ltrim(F.date_format(_c(x), pattern), F.lit("+"))


def epoch_date(x: Column | str) -> Column:
    return dated(F.timestamp_seconds(_c(x)), "yyyy-MM-dd")


def day_bounds(d: Column | str) -> tuple[Column, Column]:
    day = dated(d, "yyyyMMdd")
    return F.concat(day, F.lit("000000")), F.concat(day, F.lit("235959"))


def strip_reasoning(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"(?s)^.*</think>", ""))


def tolerant_json(x: Column | str) -> Column:
    """The object in a model's answer: fences dropped, else from the first { to the last }; null if that is no JSON."""
    bare = F.trim(F.regexp_replace(strip_reasoning(x), "```[a-z]*", ""))
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda s: F.when(F.try_parse_json(s).isNotNull() & s.startswith("{"), s)
    return F.coalesce(ok(bare), ok(span))


def json_or_raw(x: Column | str) -> Column:
    """tolerant_json, or an object that holds the whole answer as raw_response."""
    return F.coalesce(tolerant_json(x), F.to_json(F.struct(_c(x).alias("raw_response"))))


def render_template(template: str, slots: dict[str, Column | str]) -> Column:
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_c(value).cast("string"), F.lit("")))
    return out


def structured_terms(terms: Column | str, glosses: Column | str) -> Column:
    """Terms paired with glosses; a shorter list of glosses leaves empty ones."""
    return F.zip_with(_c(terms), _c(glosses), lambda t, g: F.struct(t.alias("term"), F.coalesce(g, F.lit("")).alias("english")))


def significance_stars(p: Column | str) -> Column:
    return F.when(_c(p) < 0.001, "***").when(_c(p) < 0.01, "**").when(_c(p) < 0.05, "*").otherwise("")


def length_ratio_warning(source: Column | str, translated: Column | str) -> Column:
    r = F.length(_c(translated)) / F.greatest(F.length(_c(source)), F.lit(1))
    return F.when(r < 0.3, "severe").when(r < 0.5, "short").otherwise("ok")


def packed_chunks(x: Column | str, size: int = 400) -> Column:
    """Sentences packed greedily into chunks of at most size characters (a longer sentence is a chunk of its own)."""
    parts = F.split(_c(x), r"(?<=[.!?])\s+")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fits = F.length(joined) <= size
        done = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(done.alias("done"), F.when(fits | (acc["open"] == ""), joined).otherwise(s).alias("open"))

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def json_list(x: Column | str, fields: str) -> Column:
    """The list of objects in a model's answer: a list as it is, a lone object as a list of one, prose around either cut."""
    bare = F.trim(F.regexp_replace(strip_reasoning(x), "```[a-z]*", ""))
    listed, single = F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    one = F.from_json(F.when(single != "", single), f"struct<{fields.replace(' ', ':')}>")
    return F.coalesce(F.from_json(F.when(listed != "", listed), f"array<struct<{fields.replace(' ', ':')}>>"), F.when(one.isNotNull(), F.array(one)))
