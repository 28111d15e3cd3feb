"""Column functions that the operators share. Rates, rounding and clamps are null-safe; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shown for evidence without a topic.
UNSORTED = "غير مصنّف"


def safe_rate(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """scale * part / whole; NULL where whole is null, zero or negative."""
    return F.when(whole > 0, F.lit(scale) * part / whole)


def rounded(x: Column, digits: int = 1) -> Column:
    return F.bround(x, digits)


def rounded_exactly(x: Column, digits: int = 1) -> Column:
    """x to `digits` places, half-even on the exact value of the double, as Python's round: 2.675 to 2.67, 0.25 to 0.2.

    The product by the power of ten is split into its double and the error that this left out (by halves of 26 bits, whose
    products are exact), so a tie is one only if the binary value is. Doubles too large to have such places, infinities and
    NaN come back as they are, NULL as NULL."""
    x = x.cast("double")
    scale = float(10**digits)
    half = lambda v: v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)  # noqa: E731  the upper 26 bits
    product = x * F.lit(scale)
    upper = half(x)
    lower = x - upper
    s_upper = 134217729.0 * scale - (134217729.0 * scale - scale)
    s_lower = scale - s_upper
    error = ((upper * s_upper - product) + upper * s_lower + lower * s_upper) + lower * s_lower
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    plain = F.isnan(x) | (F.abs(x) >= 2.0**52 / scale)
    return F.when(plain, x).otherwise((whole + F.when(up, 1.0).otherwise(0.0)) / scale)


def filled(template: Column, values: Column) -> Column:
    """A template with its {name} marks filled from a map of texts; a mark without a value stays, a null template is NULL.
    Values are put in as they are: a mark within a value isn't filled again."""
    parts = F.split(template, r"(?=\{[A-Za-z_][A-Za-z0-9_]*\})|(?<=\})")
    name = lambda p: F.regexp_extract(p, r"^\{([A-Za-z_][A-Za-z0-9_]*)\}$", 1)
    return F.array_join(F.transform(parts, lambda p: F.when(name(p) == "", p).otherwise(F.coalesce(F.try_element_at(values, name(p)), p))), "")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def collapsed(x: Column) -> Column:
    """Runs of white space become one space, both ends trimmed."""
    return F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))


def query_key(x: Column) -> Column:
    return F.sha2(F.lower(collapsed(x)), 256)


def token_estimate(x: Column) -> Column:
    """Half the UTF-8 bytes, rounded up, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor((F.octet_length(F.coalesce(x, F.lit(""))) + 1) / 2))


def stamp(seconds: Column) -> Column:
    """Seconds as HH:MM:SS."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def seconds(x: Column) -> Column:
    """HH:MM:SS as seconds."""
    part = lambda i: F.split_part(x, F.lit(":"), F.lit(i)).cast("bigint")
    return part(1) * 3600 + part(2) * 60 + part(3)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) / 1e6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def redacted_url(x: Column) -> Column:
    """A text whose http and https addresses have lost their token, expires and token_path parameters, in any case of
    letters; where no parameter is left a marker stands in their place. NULL stays NULL."""

    def clean(run: Column) -> Column:
        at = F.regexp_extract(run, r"https?://.", 0)
        lead = F.when(at == "", run).otherwise(F.regexp_extract(run, r"(?s)^(.*?)https?://.", 1))
        url = F.substr(run, F.length(lead) + 1)
        head = F.substring_index(url, "?", 1)
        query = F.substr(url, F.length(head) + 2)
        kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin("token", "expires", "token_path"))
        return F.when((at == "") | (query == ""), run).otherwise(F.concat(lead, head, F.lit("?"), F.when(F.size(kept) > 0, F.array_join(kept, "&")).otherwise("…")))

    # an address ends before white space, a quote or an angle bracket: runs of other characters are looked at one by one
    runs = F.split(x, r"(?U)(?<=[\s\"'<>])|(?=[\s\"'<>])")
    return F.array_join(F.transform(runs, clean), "")


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """https, without user info or port, and of an allowed host."""
    bare = F.lower(F.regexp_extract(url, r"(?i)^https://([^/?#@:]+)(?:[/?#]|$)", 1))
    return bare.isin([h.lower() for h in hosts])


def label(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first step that value reaches, from the highest down; NULL stays NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for least, name in steps:
        out = out.when(value >= least, name)
    return out.otherwise(rest)


def answer_key(x: Column) -> Column:
    """A text as answers are compared: lower case, without white space at its ends."""
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def messages_estimate(messages: Column, system: Column | None = None) -> Column:
    """The token estimate of an array of messages (role, content): 8 at the base and 8 a message, beside the texts and the
    roles. A null array counts as empty, a null or empty system text adds nothing."""
    base = F.lit(8).cast("bigint") + (F.lit(0) if system is None else F.when(F.coalesce(F.length(system), F.lit(0)) > 0, token_estimate(system)).otherwise(0))
    each = F.transform(messages, lambda m: F.lit(8) + token_estimate(m["role"]) + token_estimate(m["content"]))
    return base + F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0))


# The blocks of Arabic letters, and words that mark the Egyptian dialect.
ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿ]"
EGYPTIAN = ["إيه", "ايه", "إزاي", "ازاي", "ليه", "عايز", "عاوز", "ده", "دي", "دول", "مش", "مفيش", "فين", "كده", "بتاع", "قولي", "اشرحلي"]


def uses_arabic(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(ARABIC)


def uses_egyptian(x: Column) -> Column:
    """Whether a marker of the dialect stands as a word of its own."""
    return F.coalesce(x, F.lit("")).rlike(rf"(?U)(?:^|\s)(?:{'|'.join(EGYPTIAN)})(?:\s|$|[؟?!،,.])")


def renditions(x: Column) -> Column:
    """The heights of a text such as `240p,360p`, in ascending order; parts that are no height are left out."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.regexp_extract(F.lower(F.trim(p)), r"^([0-9]+)p?$", 1))
    return F.array_sort(F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("int")))


def height_at_or_below(heights: Column, wanted: Column) -> Column:
    """The greatest height at or below the one wanted, else the least; NULL without heights."""
    return F.coalesce(F.array_max(F.filter(heights, lambda h: h <= wanted)), F.array_min(heights))


def local_midnight(day: Column, zone: str) -> Column:
    """The UTC stamp (no zone) at which a local day begins."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def seconds_to_midnight(ts: Column) -> Column:
    """Whole seconds from a UTC stamp to its next midnight, rounded up, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(86400) - epoch(ts) + F.floor(epoch(ts) / 86400) * 86400))


def real_time_factor(audio: Column, work: Column) -> Column:
    """Seconds of audio a second of work, to one place; NULL where no work was measured."""
    return F.bround(F.try_divide(audio, work), 1)
