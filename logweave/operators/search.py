"""Full-text search over level, service, message and host, with filters, paging and suggestions.

Two ways give the same rows. The scan path tests each row: a cheap substring test of the first
letters of every stem goes first, and only the words that pass it are stemmed. The index path
reads the postings of the query words and joins the rows they name.

Rank is the sum of field weight times occurrences. Weights are 1.0 for level and service, 0.4
for the message and 0.2 for the host; they are summed as tenths to stay exact.
"""

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.functions.text import STOP_WORDS, stem, tokens
from logweave.functions.times import time_lit
from logweave.model import LOG_COLUMNS, SORT_FIELDS
from logweave.operators.filters import filter_eq, filter_levels, filter_metadata, filter_time, ilike

# Field weights in tenths.
FIELD_WEIGHTS = {"level": 10, "service_name": 10, "message": 4, "host": 2}
FIELD_LABELS = {"level": "A", "service_name": "A", "message": "B", "host": "C"}

MOST_WORDS = 2000
_TASK_BYTES = 8 << 20  # text whose postings one task sorts

_MAX_ENDING = 2  # letters a stem may differ in from the start of its word, counted from its end


def query_terms(spark, q):
    """``[(word, stem)]`` of the query without stop words, one entry per stem.

    The stems come from a plan of literals alone; no table is read.
    """
    words = [w for w in dict.fromkeys(re.findall(r"\d+(?:\.\d+)+|[^\W_]+", (q or "").lower()))
             if w not in STOP_WORDS]
    if not words:
        return []
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("word"))
    stems = {r["word"]: r["stem"] for r in asked.select("word", stem("word").alias("stem")).collect()}
    first = {}
    for w in words:
        first.setdefault(stems[w], w)
    return [(w, s) for s, w in first.items()]


def _start(word, stemmed):
    """Letters every word with this stem starts with."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    return stemmed[:max(len(stemmed) - _MAX_ENDING, 1)]


def _starts_like(token, terms):
    near = F.lit(False)
    for word, stemmed in terms:
        near = near | F.startswith(token, F.lit(_start(word, stemmed)))
    return near


def _stem_of(token, terms):
    """Stem of a word that starts like a term; the query's own words need no work."""
    known = F
    for word, stemmed in terms:
        known = known.when(token == word, stemmed)
    return known.otherwise(stem(token))


def _weighted(name, weight):
    return F.transform(tokens(name), lambda t: F.struct(t.alias("word"), F.lit(weight).alias("tenths")))


def hits(terms, fields=FIELD_WEIGHTS):
    """The words of a row that match a term, as ``array<struct<stem, tenths>>``."""
    starts = [_start(w, s) for w, s in terms]
    stops = [w for w in STOP_WORDS if w.startswith(tuple(starts))]
    words = F.concat(*[_weighted(name, weight) for name, weight in fields.items()])
    near = F.filter(words, lambda x: _starts_like(x["word"], terms) & ~(x["word"].isin(stops) if stops else F.lit(False)))
    found = F.transform(near, lambda x: F.struct(_stem_of(x["word"], terms).alias("stem"), x["tenths"].alias("tenths")))
    return F.filter(found, lambda x: x["stem"].isin([s for _, s in terms]))


def match_fts(df, terms, fields=FIELD_WEIGHTS):
    """Rows in which every term occurs in some field, with the ``rank`` of each."""
    if not terms:
        return df.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    for word, stemmed in terms:
        near = F.lit(False)
        for name in fields:
            near = near | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(_start(word, stemmed))), F.lit(False))
        df = df.where(near)
    found = df.withColumn("_hits", hits(terms, fields))
    found = found.where(F.size(F.array_distinct(F.col("_hits.stem"))) == len(terms))
    tenths = F.aggregate("_hits.tenths", F.lit(0), lambda total, t: total + t)
    return found.withColumn("rank", tenths / F.lit(10.0)).drop("_hits")


def _filtered(df, service_name=None, level=None, levels=None, environment=None, trace_id=None,
              start_time=None, end_time=None, host=None, metadata_filters=None):
    df = filter_eq(df, service_name=service_name, level=level.upper() if level else None,
                   environment=environment, trace_id=trace_id, host=host)
    df = filter_time(filter_levels(df, levels), start_time, end_time)
    return filter_metadata(df, metadata_filters)


def sort_order(sort_by="timestamp", order="desc", by_rank=False):
    """Order columns with PostgreSQL's place for nulls and ``id`` as the last key."""
    sort_by, order = sort_by.strip().lower(), order.strip().lower()
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {sort_by!r}, use one of {', '.join(SORT_FIELDS)}")
    if order not in ("asc", "desc"):
        raise ValueError("sort order must be 'asc' or 'desc'")
    key = (lambda c: F.asc_nulls_last(c)) if order == "asc" else (lambda c: F.desc_nulls_first(c))
    head = [F.desc("rank")] if by_rank and sort_by == "timestamp" else []
    return head + [key(sort_by)] + ([] if sort_by == "id" else [key("id")])


def matching(df, q=None, index=None, **filters):
    """All rows of a search with their ``rank``, unordered."""
    rows = _filtered(df, **filters)
    if not (q and q.strip()):
        return rows.withColumn("rank", F.lit(0.0))
    terms = query_terms(df.sparkSession, q)
    if index is not None:
        return _by_index(rows, terms, index)
    return match_fts(rows, terms)


def search(df, q=None, page=1, page_size=50, sort_by="timestamp", sort_order_="desc", index=None,
           after=None, **filters):
    """One page of a search. Deep pages: pass ``after=(value, id)``, the sort column and the id of the
    last row seen, instead of a page number; the skipped rows become a filter on the sort key. Results
    in order of rank have no such key, so ``after`` with ``q`` in the default order is an error."""
    if int(page) < 1 or int(page_size) < 1:
        raise ValueError("page and page_size start at 1")
    rows = matching(df, q, index, **filters)
    columns = [c for c in LOG_COLUMNS if c in rows.columns] + ["rank"]
    ranked = bool(q and q.strip())
    order = sort_order(sort_by, sort_order_, ranked)
    if after is not None:
        if ranked and sort_by.strip().lower() == "timestamp":
            raise ValueError("after needs a sort column when results are ranked")
        rows, page = rows.where(_behind(df, sort_by.strip().lower(), sort_order_.strip().lower(), *after)), 1
    return rows.select(columns).orderBy(*order).offset((int(page) - 1) * int(page_size)).limit(int(page_size))


def _behind(df, sort_by, order, value, key):
    """Whether a row comes after ``(value, key)`` in the order of :func:`sort_order`."""
    at, own = F.col(sort_by), F.col("id")
    later = own > key if order == "asc" else own < key
    if sort_by == "id":
        return later
    if value is None:  # nulls are last going up, first going down
        return at.isNull() & later if order == "asc" else at.isNotNull() | later
    mark = time_lit(df, value) if sort_by in ("timestamp", "ingested_at") else F.lit(value)
    beyond = (at > mark) | at.isNull() if order == "asc" else at < mark
    return beyond | ((at == mark) & later)


def count_search(df, q=None, page_size=50, index=None, **filters):
    """Total rows and pages of a search, as one row."""
    rows = _filtered(df, **filters)
    if q and q.strip():
        terms = query_terms(df.sparkSession, q)
        rows = _by_index(rows, terms, index) if index is not None else match_fts(rows, terms)
    return rows.agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.greatest(F.ceil(F.col("total") / page_size), F.lit(1)).cast("bigint"))


# --- index -------------------------------------------------------------------

def build_postings(df, fields=FIELD_LABELS):
    """``term, id, weight, pos``: every occurrence of every word that is no stop word."""
    parts = F.array(*[F.struct(F.lit(label).alias("weight"), tokens(name).alias("words"))
                      for name, label in fields.items()])
    per_field = df.select("id", F.posexplode(parts).alias("_field", "part"))
    words = per_field.select("id", "_field", "part.weight", F.posexplode("part.words").alias("pos", "term"))
    return words.where(~F.col("term").isin(STOP_WORDS)).select("term", "id", "weight", "_field", "pos")


def term_dictionary(postings):
    """``term, stem, occurrences``: each distinct word is stemmed once."""
    counts = postings.groupBy("term").agg(F.count("*").alias("occurrences"))
    return counts.select("term", stem("term").alias("stem"), "occurrences")


def build_search_index(df, path=None):
    """Postings and dictionary; written under ``path`` when given.

    Written postings are range-partitioned by term and id: a word's rows lie together, and the
    rows of a very common word spread over as many files as they need. Postings name rows by id, so
    an index is not written over repeated ids: an error.
    """
    postings = build_postings(df)
    if path is None:
        return postings, term_dictionary(postings)
    text = sum(F.coalesce(F.octet_length(name), F.lit(0)) for name in FIELD_LABELS)
    ids = df.groupBy("id").agg(F.count("*").alias("n"), F.sum(text.cast("long")).alias("bytes"))
    most, size = ids.agg(F.max_by(F.struct("id", "n"), "n"), F.sum("bytes")).first()
    if most and most["n"] > 1:
        raise ValueError(f"id {most['id']} is on {most['n']} rows; an index needs ids of their own")
    # a word's postings compress well, so tasks cut by shuffled bytes would hold very many of them
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // _TASK_BYTES))
    (postings.repartitionByRange(tasks, "term", "id").sortWithinPartitions("term", "id")
     .write.mode("overwrite").parquet(f"{path}/postings"))
    spark = df.sparkSession
    postings = spark.read.parquet(f"{path}/postings")
    term_dictionary(postings).write.mode("overwrite").parquet(f"{path}/dictionary")
    return postings, spark.read.parquet(f"{path}/dictionary")


def _by_index(rows, terms, index):
    """Rows named by the postings of all terms. The dictionary words of the query's stems are read
    first: as literals they reach the scan of the postings, which lie sorted by word. A stem has a
    handful of words; more than ``MOST_WORDS`` go through a join."""
    if not terms:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    postings, dictionary = index
    stems = [s for _, s in terms]
    place = F.array_position(F.lit(stems), F.col("stem")).cast("int")
    wanted = dictionary.where(F.col("stem").isin(stems)).select("term", (place - 1).alias("_place"))
    words = [r["term"] for r in wanted.select("term").limit(MOST_WORDS + 1).collect()]
    if len(words) <= MOST_WORDS:
        postings = postings.where(F.col("term").isin(words))
    weight = F.when(F.col("weight") == "A", 10).when(F.col("weight") == "B", 4).otherwise(2)
    ids = (
        postings.join(wanted, "term")
        .groupBy("id")
        .agg(F.size(F.collect_set("_place")).alias("_found"), F.sum(weight).alias("_tenths"))
        .where(F.col("_found") == len(stems))
    )
    return rows.join(ids, "id").withColumn("rank", F.col("_tenths") / F.lit(10.0)).drop("_found", "_tenths")


def rarest_term(dictionary, q):
    """Occurrences of the query's rarest term: the index pays off when this is a small share of
    the table, the scan otherwise. One row; 0 when a term does not occur at all."""
    stems = [s for _, s in query_terms(dictionary.sparkSession, q)]
    asked = F.explode(F.array(*[F.lit(s) for s in stems]) if stems else F.array().cast("array<string>"))
    asked = dictionary.sparkSession.range(1).select(asked.alias("stem"))
    return (asked.join(dictionary, "stem", "left").groupBy("stem").agg(F.sum("occurrences").alias("n"))
            .agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("rarest")))


def trigram_index(df, col="message"):
    """``gram, id``: the distinct three-letter pieces of each lower-cased text."""
    rows = df.select("id", F.lower(F.col(col)).alias("_text")).where(F.length("_text") >= 3)
    grams = F.transform(F.sequence(F.lit(1), F.length("_text") - 2), lambda i: F.substring("_text", i, F.lit(3)))
    return rows.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


def trigram_search(df, grams, term, col="message"):
    """Rows whose text contains ``term``: candidates from the pieces, then the real test."""
    term_ = term.lower()
    pieces = list(dict.fromkeys(term_[i:i + 3] for i in range(len(term_) - 2)))
    rows = df
    if pieces:
        ids = grams.where(F.col("gram").isin(pieces)).groupBy("id").agg(F.count("*").alias("_n"))
        rows = df.join(ids.where(F.col("_n") == len(pieces)).select("id"), "id", "left_semi")
    return rows.where(ilike(col, term))


# --- suggestions and highlights ----------------------------------------------

def _cut(text, chars):
    return F.col(text) if chars is None else F.substring(text, 1, chars)


def latest_per_prefix(df, prefix=None, shown=None):
    """Newest message of each group of messages with the same start (``prefix`` characters, default the
    whole text), cut to ``shown`` characters if given; a map-side combined maximum."""
    newest = F.max_by(_cut("message", shown), F.struct("timestamp", "id"))
    return df.groupBy(_cut("message", prefix).alias("prefix")).agg(newest.alias("newest"))


_SUGGESTED = ("service", "message", "host")


def _smallest(rows, k):
    """The ``k`` smallest keys of an Arrow table, each with its newest row; nulls are oldest."""
    rows = rows.sort_by([("key", "ascending"), ("at", "descending"), ("id", "descending")])
    if rows.num_rows > 1:
        key = rows["key"].combine_chunks()
        new = pc.not_equal(key[1:], key[:-1])
        rows = rows.filter(pa.concat_arrays([pa.array([True]), new]))
    return rows.slice(0, k)


def _first_keys(k):
    """What a task adds to the suggestions: per type its ``k`` smallest keys. The smallest keys of the whole
    table are among those of every task that holds them, so nothing is lost."""
    def run(batches):
        held = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for kind in _SUGGESTED:
                mine = rows.filter(pc.is_valid(rows[f"{kind}_key"]))
                mine = pa.table({"key": mine[f"{kind}_key"], "suggestion": mine["shown" if kind == "message" else f"{kind}_key"], "at": mine["at"], "id": mine["id"]})
                if kind in held and held[kind].num_rows == k:
                    mine = mine.filter(pc.less_equal(mine["key"], held[kind]["key"][k - 1]))
                held[kind] = _smallest(pa.concat_tables([held[kind], mine]) if kind in held else mine, k)
        for kind, rows in held.items():
            yield from rows.append_column("type", pa.array([kind] * rows.num_rows, pa.string())).combine_chunks().to_batches()
    return run


def suggest(df, term, limit=10, prefix=None, shown=None):
    """Services, newest message of each start (see :func:`latest_per_prefix`), and hosts that contain the
    term, at most ``limit`` of each and of all, in order of type and text. One scan; a task sends at most
    ``limit`` keys of each type on. A blank term or a limit below 1 suggests nothing."""
    term = (term or "").strip()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    held = df.select(
        F.when(ilike("service_name", term), F.col("service_name")).alias("service_key"),
        F.when(ilike("message", term), _cut("message", prefix)).alias("message_key"),
        F.when(ilike("host", term), F.col("host")).alias("host_key"),
        F.when(ilike("message", term), _cut("message", shown)).alias("shown"), F.col("timestamp").alias("at"), "id")
    held = held.where(F.coalesce("service_key", "message_key", "host_key").isNotNull() if term and limit > 0 else F.lit(False))
    found = held.mapInArrow(_first_keys(max(limit, 1)), f"key string, suggestion string, at {kinds['timestamp']}, id {kinds['id']}, type string")
    newest = found.groupBy("type", "key").agg(F.max_by("suggestion", F.struct("at", "id")).alias("suggestion"))
    first = newest.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("key"))).where(F.col("n") <= limit)
    return first.where("suggestion <> ''").select("suggestion", "type").orderBy("type", "suggestion").limit(max(limit, 0))


def highlight(df, q, col="message", before="<b>", after="</b>"):
    """Mark the words of a page of results that match the query."""
    terms = query_terms(df.sparkSession, q)
    if not terms:
        return df
    stems = [s for _, s in terms]
    near = F.filter(tokens(col), lambda t: _starts_like(t, terms) & ~t.isin(STOP_WORDS))
    words = F.array_distinct(F.filter(near, lambda t: _stem_of(t, terms).isin(stems)))
    # longest first, so that "time" does not cut "timeout"
    words = F.reverse(F.array_sort(words))
    dotted = F.replace(F.array_join(words, "|"), F.lit("."), F.lit("\\."))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), dotted, F.lit(r")(?![\p{L}\p{N}])"))
    marked = F.regexp_replace(F.col(col), pattern, F.lit(f"{before}$1{after}"))
    return df.withColumn(col, F.when(F.size(words) > 0, marked).otherwise(F.col(col)))


# --- exports -----------------------------------------------------------------

def export_rows(df, limit=None, columns=None, **filters):
    """Search result for export: newest first, all rows or the first ``limit``."""
    rows = matching(df, **filters).orderBy(*sort_order(by_rank=bool(filters.get("q"))))
    return (rows if limit is None else rows.limit(limit)).select(columns or "*")


_ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
EXPORT_COLUMNS = ["timestamp", "level", "service_name", "message", "host", "trace_id", "environment"]


def export_csv(df, path, limit=None, chars=None, **filters):
    rows = export_rows(df, limit, EXPORT_COLUMNS, **filters)
    rows = rows.withColumn("message", _cut("message", chars))
    rows.write.mode("overwrite").options(header=True, escape='"', **_ISO).csv(path)


def export_json(df, path, limit=None, **filters):
    """JSON lines under ``path/logs``, and one line ``count, exported_at`` under ``path/summary``."""
    rows = export_rows(df, limit, EXPORT_COLUMNS + ["metadata"], **filters)
    rows.withColumn("metadata", F.try_parse_json("metadata")).write.mode("overwrite").options(**_ISO).json(f"{path}/logs")
    written = df.sparkSession.read.json(f"{path}/logs", schema="level string")
    written.agg(F.count("*").alias("count"), F.current_timestamp().alias("exported_at")).write.mode(
        "overwrite").json(f"{path}/summary")
