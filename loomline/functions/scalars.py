"""Scalar functions as column expressions: text, URLs, dates, scores, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html(c: Column, by: str = " ") -> Column:
    """Without tags; `by` stands in their place."""
    return F.regexp_replace(c, "<[^>]*>", by)


# Named character references that are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    """Six named references and decimal ones up to five digits decoded, once each; & comes last, so that nothing is decoded twice."""
    number = F.regexp_extract_all(c, F.lit("&#([0-9]{1,5});"), 1)
    c = F.aggregate(F.array_distinct(number), c, lambda s, n: F.when(n.cast("int").between(32, 55295), F.replace(s, F.concat(F.lit("&#"), n, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 4, "0")), "UTF-16BE"))).otherwise(s))
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def xml_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def cdata(c: Column) -> Column:
    """A CDATA section; an end mark within is cut in two."""
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def specific_url(c: Column) -> Column:
    """Whether a URL names a page rather than a site: it has a path or a query."""
    path, question = F.regexp_replace(F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", ""), F.regexp_extract(c, r"^[^?#]+\?([^#]*)", 1)
    return F.coalesce(c.rlike("(?i)^https?://[^/?#]+") & ((path != "") | (question != "")), F.lit(False))


def comparable_url(c: Column) -> Column:
    """Scheme and host in lower case, without fragment and slashes at the path's end."""
    m = lambda k: F.regexp_extract(c, r"^([A-Za-z]+://[^/?#]+)([^?#]*)(\?[^#]*)?", k)
    return F.concat(F.lower(m(1)), F.when(F.length(m(2)) > 1, F.regexp_replace(m(2), "/+$", "")).otherwise(F.lit("/")), m(3))


def child_title(c: Column) -> Column:
    """Emphasis and brackets off, white space collapsed, 120 characters at most; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[`_\[\]()#>]", ""), r"\s+", " "))
    return F.when(t != "", F.substring(t, 1, 120))


ZONES = r"(?i)\b(?:CST|EST|PST|MST|IST|BST)\b"


def published_at(c: Column) -> Column:
    """A publication time in UTC, null if it is none: ambiguous zones, dates without a time and impossible dates are none. A time
    without a zone is UTC+8."""
    t = F.trim(c)
    iso = F.regexp_replace(F.regexp_replace(t, "T", " "), r"\.\d+", "")
    zoned = t.rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2}|\b(?:GMT|UT)\b)$")
    rest = F.regexp_replace(F.regexp_replace(t, r"^\w{3},\s*", ""), r"(?i)\b(?:GMT|UT)$", "+0000")
    bare = F.trim(F.regexp_replace(iso, r"(?i)(?:Z|[+-]\d{2}:?\d{2})$", ""))
    minutes = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 2).try_cast("int") * 60 + F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 3).try_cast("int")
    shift = F.coalesce(F.when(F.regexp_extract(t, r"([+-])\d{2}:?\d{2}$", 1) == "-", -minutes).otherwise(minutes), F.when(zoned, 0).otherwise(480))
    plain = F.regexp_replace(F.trim(F.regexp_replace(rest, r"(?i)(?:Z|[+-]\d{2}:?\d{2})$", "")), r"\s+", " ")
    local = F.coalesce(F.expr("null").cast("timestamp_ntz"), *[F.try_to_timestamp(x, F.lit(f)).cast("timestamp_ntz") for x, f in ((bare, "yyyy-MM-dd HH:mm:ss"), (bare, "yyyy-MM-dd HH:mm"), (plain, "d MMM yyyy HH:mm:ss"), (plain, "d MMM yyyy HH:mm"))])
    named = ~zoned & t.rlike(r"(?i)\b[A-Z]{2,5}$")
    return F.when(~t.rlike(ZONES) & t.rlike(r"\d[T ]\d{1,2}:\d{2}") & ~named, local - F.make_dt_interval(mins=shift))


def known_date(old: Column, old_known: Column, new: Column, new_known: Column) -> tuple[Column, Column]:
    """(value, known): a known date gives way to a known one alone."""
    keep = F.coalesce(old_known, F.lit(False)) & ~new_known
    return F.when(keep, old).otherwise(new), F.coalesce(old_known, F.lit(False)) | new_known


def author(c: Column) -> Column:
    """An author from plain text or from a JSON object's name, title or email, the first text of a list; null if blank."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    field = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("name", "title", "email")])
    listed = F.try_element_at(F.filter(F.from_json(field, "array<string>"), lambda x: F.trim(x) != ""), F.lit(1))
    return F.when(c.startswith("{"), F.when(field.startswith("["), F.trim(listed)).otherwise(blank(field))).otherwise(blank(c))


def at_sentence_end(c: Column, most: int) -> Column:
    """At most `most` characters, cut after the last full stop within if one stands in the second half; unpaired emphasis at the end goes."""
    head = F.substring(c, 1, most)
    upto = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
    cut = F.when(F.length(c) <= most, c).when(F.length(upto) * 2 >= most, upto).otherwise(F.rtrim(head))
    odd = F.regexp_count(cut, F.lit(r"\*\*")) % 2 == 1
    return F.when(odd, F.regexp_replace(cut, r"(?s)\*\*(?!.*\*\*)", "")).otherwise(cut)


def snapped(value: Column, levels: list[int]) -> Column:
    """The nearest level, the lower of two equally near ones."""
    near = F.array_min(F.transform(F.array(*map(F.lit, levels)), lambda x: F.struct(F.abs(x - value).alias("d"), x.alias("x"))))
    return F.when(value.isNotNull(), near["x"])


# What is masked before a request is kept.
SECRETS = ((r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[redacted]"), (r"(?i)((?:api[_-]?key|token|password|secret)\"?\s*[:=]\s*\"?)[^\s\",}]+", "$1[redacted]"), (r"\bsk-[A-Za-z0-9_-]{8,}", "[redacted]"))


def redacted(c: Column, most: int = 32 * 1024) -> Column:
    """Secrets masked, then at most `most` bytes, a character never cut."""
    for pattern, by in SECRETS:
        c = F.regexp_replace(c, pattern, by)
    # a character that the cut leaves incomplete is a leading byte with too few bytes after it
    cut = F.regexp_replace(F.hex(F.substring(F.encode(c, "UTF-8"), 1, most)), "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.unhex(cut), "UTF-8"))


def local_day(c: Column, hours: int = 8) -> Column:
    """The day of a UTC time in a zone so many hours east."""
    return F.to_date(c + F.make_dt_interval(hours=F.lit(hours)))


def slug(c: Column) -> Column:
    """Lower case, letters and digits of ASCII and Chinese characters joined by hyphens, 120 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\u4e00-\u9fff]+", "-"), "^-+|-+$", ""), 1, 120)


def mapped_type(c: Column, aliases: dict[str, str]) -> Column:
    """An event type by key or alias, blind to case, blanks, hyphens and underscores: 'other' if unknown, null if blank."""
    fold = lambda s: "".join(ch for ch in s.lower() if ch not in " -_")
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (fold(k), v)])
    key = F.regexp_replace(F.lower(c), r"[ \-_]+", "")
    return F.when(F.trim(c) != "", F.coalesce(F.try_element_at(table, key), F.lit("other")))


def usage(c: Column, key: str) -> Column:
    """A count from a JSON payload: 0 if it is missing, negative or no whole number."""
    n = F.get_json_object(c, f"$.{key}")
    return F.when(n.rlike("^[0-9]{1,15}$"), n.cast("long")).otherwise(F.lit(0).cast("long"))
