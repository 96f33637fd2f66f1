"""Text, hashing and guard expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that retrieval leaves out, redaction patterns, denied topics, duty codes and named places.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "was", "one", "our", "out", "has", "with", "this",
    "that", "from", "have", "what", "when", "why", "how", "does", "their", "they", "were", "been", "into", "its",
)
REDACTIONS = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.]{2,}"),
    ("PHONE", r"\b(?:\+?1[ -]?)?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}\b"),
    ("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
)
DENIED = (r"\b(credit card|ssn|social security)\b", r"\b(fire|terminate|discipline)\s+(the\s+)?(agent|employee|staff)")
INJECTION = r"ignore (all |your )?(previous|prior) instructions"
DENIED_REASON = "denied topic: outside the operational scope of this assistant"
INJECTION_REASON = "prompt injection pattern detected"
UNGROUNDED_REASON = "failed contextual grounding: answer not supported by retrieved sources"
PLACES = {"dallas": "drv-1000", "austin": "drv-1016", "denver": "drv-1027", "chicago": "drv-1038", "phoenix": "drv-1049"}
EMBED_DIMS = 256
LEAST_GROUNDING = 0.15


def content_id(*parts: Column) -> Column:
    """24 hex digits over the parts joined by '|'; a null part makes a null id."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p.cast("string"))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 24)


def tokens(text: Column) -> Column:
    """Lower-cased words of over two characters without stop words, in order, repeats kept."""
    cut = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.filter(cut, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def embedding_bucket(token: Column) -> Column:
    return (F.conv(F.substring(F.sha2(token.cast("binary"), 256), 1, 4), 16, 10).cast("int") % EMBED_DIMS).cast("int")


def embedding(text: Column) -> Column:
    """Hashed bag of words of unit length as a dense array; all zero for no words."""
    buckets = F.transform(tokens(text), embedding_bucket)
    counts = F.transform(F.sequence(F.lit(0), F.lit(EMBED_DIMS - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def redact(text: Column) -> Column:
    for label, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[{label}_REDACTED]")
    return text


def input_reason(text: Column) -> Column:
    """Why a question is refused, or null."""
    denied = text.rlike(f"(?i){DENIED[0]}") | text.rlike(f"(?i){DENIED[1]}")
    return F.when(denied, DENIED_REASON).when(text.rlike(f"(?i){INJECTION}"), INJECTION_REASON)


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's words of over four characters that the context has; 1 without such words."""
    known = F.split(F.lower(context), r"\W+")
    said = F.filter(F.split(F.lower(answer), r"\W+"), lambda t: F.length(t) > 4)
    hits = F.size(F.filter(said, lambda t: F.array_contains(known, t)))
    return F.when(F.size(said) == 0, F.lit(1.0)).otherwise(hits / F.nullif(F.size(said), F.lit(0)))


def output_reason(answer: Column, context: Column) -> Column:
    """Why an answer is withheld, or null; without context nothing is checked."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.when(grounding(answer, context) < LEAST_GROUNDING, UNGROUNDED_REASON))


def snippet(text: Column, size: int = 140) -> Column:
    return F.concat(F.substring(F.regexp_replace(text, r"\s+", " "), 1, size), F.lit("..."))


def one_line(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > 170, F.concat(F.substring(flat, 1, 167), F.lit("..."))).otherwise(flat)


def named_driver(text: Column) -> Column:
    """A driver id written in the text, else that of the first place named."""
    out = F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(drv-\d{4})\b", 1)), F.lit(""))
    place = F.lit(None).cast("string")
    for name, driver in reversed(PLACES.items()):
        place = F.when(F.contains(F.lower(text), F.lit(name)), driver).otherwise(place)
    return F.coalesce(out, place)


def source_of(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"SOURCE (\S+)", 1), F.lit("")), F.lit("telemetry"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def email_domain(email: Column) -> Column:
    return F.lower(F.coalesce(F.get(F.split(email, "@"), F.lit(1)), F.lit("")))


def b64url(data: Column) -> Column:
    """Unpadded and in one line; ``base64`` may break its output after 76 characters."""
    return F.rtrim(F.translate(F.base64(data.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def from_b64url(text: Column) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.unbase64(padded).cast("string")


def date_hour(at: Column) -> dict[str, Column]:
    return {"dt": F.date_format(at, "yyyy-MM-dd"), "hh": F.date_format(at, "HH")}


def witness(providers: Column, paged: Column) -> Column:
    """How many sources agree, as the board says it."""
    n = F.size(providers)
    return F.when(n > 1, F.concat(F.array_join(providers, " + "), F.lit(" agree"))).when(paged, F.concat(F.array_join(providers, ""), F.lit(" + a second signal"))).otherwise(F.concat(F.array_join(providers, ""), F.lit(" only")))
