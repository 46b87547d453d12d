"""Fingerprints and templates: variable parts of a message replaced by tags."""

from pyspark.sql import functions as F

# Masking patterns and tags, applied in this order.
FINGERPRINT_MASKS = [
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"(?U)\b\d{4,}\b", "<ID>"),
    (r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"(?U)\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"(?Ui)\b[0-9a-f]{8,}\b", "<HEX>"),
]
TEMPLATE_MASKS = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    (r"(?U)\b\d{4,}\b", "<num>"),
    (r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<ts>"),
    (r"[0-9a-f]{8,}", "<hex>"),
]
FINGERPRINT_HEX = 16


def _column(c):
    return F.col(c) if isinstance(c, str) else c


# Every Unicode white space, and the four separator controls.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c):
    """Trim every Unicode white space, not only blanks; looks at the ends of the text alone."""
    return F.btrim(_column(c), F.lit(WHITE_SPACE))


def _mask(c, masks):
    for pattern, tag in masks:
        c = F.regexp_replace(c, pattern, tag)
    return c


def error_fingerprint(message, service, chars=None):
    """Short hash that groups messages differing only in ids, addresses and times.

    The number mask comes before the time mask, so ``2024-01-15T10:30:00`` becomes
    ``<ID>-01-15T10:30:00``; stored hashes depend on that order. All of the text counts; ``chars=500``
    gives hashes that match those of stores which cut there.
    """
    masked = _mask(strip(message), FINGERPRINT_MASKS)
    if chars is not None:
        masked = F.substring(masked, 1, chars)
    return F.substring(F.md5(F.concat(_column(service), F.lit(":"), masked)), 1, FINGERPRINT_HEX)


def template_message(message):
    """Lower-cased message with its variable parts masked; the unit of pattern mining."""
    return strip(_mask(F.lower(_column(message)), TEMPLATE_MASKS))
