"""Text columns: normal forms, quote search, tokenizing, splitting, scrubbing. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of the normal forms.
BLANKS = r"[\r\n\t\f\x0B   -     　]+"
DOUBLE_QUOTES = "“”„‟«»″‶"
SINGLE_QUOTES = "‘’‚‛′‵`´"
DASHES = "‐‑‒–—―−"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
SECRET_KINDS = (
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
    (r"AIza[0-9A-Za-z_-]{20,}", "[REDACTED_AIZA]"),
    (r"AQ\.[0-9A-Za-z_-]{20,}", "[REDACTED_GEMINI_KEY]"),
    (r"sb_secret[0-9A-Za-z_-]*", "[REDACTED_SB_SECRET]"),
    (r"gsk_[0-9A-Za-z_-]*", "[REDACTED_GSK]"),
)
SECRET_KEYS = ("gemini_api_key", "geminiapikey", "authorization", "x-goog-api-key", "apikey", "secret", "password")
ADMIN_WORDS = r"\b(state of|district of|district|nct of|state|ut of|union territory of)\b"


def collapse_blanks(c: Column) -> Column:
    """Every run of white space (with no-break and typographic blanks) as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, BLANKS, " "), " +", " "))


def plain_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes and ligatures as ASCII."""
    source = DOUBLE_QUOTES + SINGLE_QUOTES + DASHES
    target = '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES)
    out = F.translate(c, source, target)
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


def join_hyphens(c: Column) -> Column:
    """Without soft hyphens and zero-width spaces, and with words joined that a hyphen and white space broke."""
    return F.regexp_replace(F.regexp_replace(c, r"[­​]", ""), r"([a-zA-Z]{2,})-[\s   -     　﻿]+([a-zA-Z]{2,})", "$1$2")


def canonical(c: Column) -> Column:
    return collapse_blanks(plain_punctuation(join_hyphens(c)))


def spelled(c: Column) -> Column:
    """A canonical text lower-cased, with currency and scale words in one spelling."""
    out = F.regexp_replace(F.lower(c), r"\u20B9|rs\.?|inr", "rs")
    out = F.regexp_replace(out, r"\bcrores?\b|\bcr\b", "crore")
    return F.regexp_replace(out, r"\blakhs?\b|\bl\b", "lakh")


def verification_form(c: Column) -> Column:
    return spelled(canonical(c))


def find_quote(page: Column, quote: Column, forms: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """STRUCT(matched, exact, tier, start, stop): verbatim, then canonical, then verification form, then canonical in lower case;
    indexes from 0, -1 for none. The last finds quotes cut within a word, whose first or last letters read as a scale word
    (a lone l as lakh) where the page has none.

    `forms` are the canonical page and quote and their verification forms, where the caller has them as columns.
    """
    cp, cq, vp, vq = forms or (canonical(page), canonical(quote), verification_form(page), verification_form(quote))
    filled = (F.length(F.coalesce(page, F.lit(""))) > 0) & (F.length(F.coalesce(quote, F.lit(""))) > 0)
    found = [
        F.when(filled & (F.instr(p, q) > 0), F.struct(F.lit(True).alias("matched"), F.lit(name == "exact").alias("exact"), F.lit(name).alias("tier"), (F.instr(p, q) - 1).alias("start"), (F.instr(p, q) - 1 + F.length(q)).alias("stop")))
        for name, p, q in (("exact", page, quote), ("canonical", cp, cq), ("verification", vp, vq), ("lower", F.lower(cp), F.lower(cq)))
    ]
    none = F.struct(F.lit(False).alias("matched"), F.lit(False).alias("exact"), F.lit(None).cast("string").alias("tier"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    return F.coalesce(*found, none)


def tokens(c: Column) -> Column:
    """Lower-cased words of a-z and 0-9 longer than two characters, in order."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 2)


def token_overlap(claim: Column, reference: Column) -> Column:
    """The share of the claim's distinct tokens that occur in the reference; 0 for a claim without tokens."""
    own = F.array_distinct(tokens(claim))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, tokens(reference))), F.size(own)), F.lit(0.0))


def place_key(c: Column) -> Column:
    """A place name for lookup: lower-cased, punctuation and administrative words removed."""
    out = F.regexp_replace(F.lower(c), r"[.,/#!$%^&*;:{}=\-_`~()]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, ADMIN_WORDS, ""), r"\s+", " "))


def ocr_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def scrub_secrets(c: Column) -> Column:
    """Key-shaped strings replaced by a marker of their kind."""
    for pattern, marker in SECRET_KINDS:
        c = F.regexp_replace(c, pattern, marker)
    return c


def scrub_map(c: Column) -> Column:
    """A MAP<STRING,STRING> with the values of secret keys hidden and key-shaped strings scrubbed in the rest."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "[REDACTED]").otherwise(scrub_secrets(v)))


def sentences(c: Column) -> Column:
    """Sentences longer than 20 characters: a text cut after . ? or ! before an upper-case letter or digit."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Trimmed paragraphs longer than 20 characters; the whole text if there is none."""
    found = F.filter(F.transform(F.split(c, separator), lambda s: F.trim(s)), lambda p: F.length(p) > 20)
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def windows(c: Column, size: int = 1000) -> Column:
    """Consecutive stretches of `size` characters."""
    count = F.greatest(F.lit(1), F.ceil(F.length(c) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(c, i * size + 1, F.lit(size)))


def document_class(c: Column) -> Column:
    """budget, audit, policy or general, by the first vocabulary that occurs."""
    return (
        F.when(c.rlike("(?i)budget|expenditure|receipts|outlay|fiscal"), "budget")
        .when(c.rlike("(?i)audit|comptroller|auditor"), "audit")
        .when(c.rlike("(?i)policy|guidelines|framework"), "policy")
        .otherwise("general")
    )


def table_class(c: Column) -> Column:
    return F.when(c.rlike("(?i)budget|alloc|spend|expend"), "budget_table").otherwise("tabular")


def glossary_term(c: Column) -> Column:
    """The term that a definition defines: the text before a colon within 40 characters, before 'means', or its first 30 characters."""
    colon, means = F.instr(c, ":") - 1, F.instr(F.lower(c), "means") - 1
    return F.trim(
        F.when((colon > 0) & (colon < 40), F.substr(c, F.lit(1), colon)).when(means > 0, F.substr(c, F.lit(1), means)).otherwise(F.substring(c, 1, 30))
    )


def short_label(c: Column, most: int = 28, kept: int = 26) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, kept), F.lit("..."))).otherwise(c)


def row_as_text(columns: list[str]) -> Column:
    """`name: value | name: value`, null as empty."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def human_bytes(c: Column) -> Column:
    """A size in B, KB or MB with one decimal."""
    return (
        F.when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024))
        .otherwise(F.format_string("%.1f MB", c / (1024 * 1024)))
    )


def strip_json_fence(c: Column) -> Column:
    """The body of a fenced JSON answer."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
