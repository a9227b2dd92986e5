"""Queries through pandas functions and other forms that SQL can't express; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import python_udfs as P
from plumbline.functions import text as T
from plumbline.operators import testbeds
from plumbline.plans.text_queries import _CUT, _SENTENCES, _WORDS


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def _neighbours(s, d):
    a = _docs(s, d).select("doc_id", F.col("text").alias("a"))
    return a.join(_docs(s, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")


def _turns(s, d):
    """Each turn beside the next one of its conversation."""
    a = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("a"))
    return a.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])


def _content_hashes(s, d):
    passages = F.array(testbeds.passage(F.col("doc_id").cast("string"), F.col("text"), True, False))
    return _docs(s, d).select("doc_id", P.content_hash(F.col("source"), passages, F.col("lang"), F.lit(None).cast("double")).alias("content_hash"))


def _aligned(s, d):
    pairs = _neighbours(s, d)
    return pairs.select("doc_id", T.aligned_sentence(F.col("b"), F.get(T.sentences(F.col("a")), F.lit(0))).alias("aligned"))


QUERIES = {
    "accent_fold": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.fold_accents(F.col("text")).cast("binary")).alias("folded")),
    "edit_fraction": lambda s, d: _turns(s, d).select("conv_id", "turn", P.edit_fraction("a", "b").alias("fraction")),
    "content_hash": _content_hashes,
    "html_repair": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(P.repair_markup("html").cast("binary")).alias("repaired")),
    "sentence_diff": lambda s, d: _neighbours(s, d).select("doc_id", P.sentence_diff("a", "b").alias("v")).select("doc_id", "v.removed", "v.added"),
    "aligned_sentences": _aligned,
}
_PAIRED = "SELECT a.doc_id, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
_LIKE = "coalesce(len(list_intersect(w, list_distinct({x})))::double / nullif(len(list_distinct(list_concat(w, {x}))), 0), 0)"
_TRIMMED = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
#: JSON in ASCII, character by character.
_ASCII = """array_to_string(list_transform(regexp_extract_all({c}, '(?s).'), lambda x: CASE WHEN x = '"' THEN '\\"' WHEN x = '\\' THEN '\\\\' WHEN x = chr(10) THEN '\\n' WHEN x = chr(13) THEN '\\r' WHEN x = chr(9) THEN '\\t' WHEN ord(x) < 32 OR ord(x) > 127 THEN '\\u' || printf('%04x', ord(x)) ELSE x END), '')"""
SQL: dict[str, str] = {
    "accent_fold": "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents",
    "content_hash": "SELECT doc_id, substr(sha256('{\"answer\": \"' || lang || '\", \"noise_ratio\": null, \"passages\": [{\"passage_id\": \"' || doc_id::varchar || '\", \"text\": \"' || " + _ASCII.format(c="text") + " || '\"}], \"query\": \"' || source || '\"}'), 1, 16) AS content_hash FROM documents",
    "sentence_diff": f"""WITH p AS ({_PAIRED}), c AS (SELECT doc_id, list_filter({_CUT(_TRIMMED('a'))}, lambda x: x <> '') AS p, list_filter({_CUT(_TRIMMED('b'))}, lambda x: x <> '') AS q FROM p)
        SELECT doc_id, list_filter(p, lambda x: NOT list_contains(q, x))[1] AS removed, list_filter(q, lambda x: NOT list_contains(p, x))[1] AS added FROM c""",
    "aligned_sentences": f"""WITH p AS ({_PAIRED}), c AS (SELECT doc_id, b, list_filter(list_transform({_CUT('b')}, lambda x: trim(x)), lambda x: x <> '') AS parts, list_distinct({_WORDS('lower(' + _SENTENCES('a') + '[1])')}) AS w FROM p)
        SELECT doc_id, CASE WHEN len(parts) = 0 THEN substr(b, 1, 400) WHEN len(w) = 0 THEN parts[1] ELSE list_max(list_transform(range(1, len(parts) + 1), lambda i: {{'j': {_LIKE.format(x=_WORDS('lower(parts[i])'))}, 'i': -i, 's': parts[i]}})).s END AS aligned FROM c""",
}
