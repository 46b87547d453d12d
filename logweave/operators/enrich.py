"""The processing step between ingest and storage."""

from pyspark.sql import functions as F

from logweave.functions.enrichment import enrich
from logweave.functions.masking import error_fingerprint
from logweave.functions.rates import is_error
from logweave.session import small_methods


def process(df, now=None, **options):
    """Enriched rows with the fingerprint of errors; one projection, no shuffle."""
    rows = enrich(small_methods(df), now=now, **options).drop("extracted", "stack_trace")
    return rows.withColumn("error_fingerprint", F.when(is_error(), error_fingerprint("message", "service_name")))
