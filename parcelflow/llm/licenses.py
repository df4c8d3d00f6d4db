"""Operator 8 [native]: license scan of files by sparse TF-IDF cosine, and inheritance from the nearest directory.

1. A file's lines and paragraphs (lines joined up to an empty one, without comment signs) are cut into sentences at
   ``.!?`` before a blank and a capital. Sentences that hold a cue word are its headers; licence files, known by their
   name, add their whole text. Each distinct header becomes a sparse TF-IDF vector (idf from the templates; words that
   no template has weigh most), and its cosine with each template is summed by joining words. Sentences are held against
   notices, whole files against whole licenses. A file declares the license of its best header with a cosine of LEAST or
   more (LEAST_WHOLE for whole files); ties go to the first license by name.
2. Licenses that are alike differ in a few words (versions, "lesser", "sa"): a sentence must have the same of these as
   the template, so a license without a template isn't taken for its sibling.
3. A directory has the license of the best licence file in it (by file name), or else the one that all declaring files
   directly in it agree on.
4. A file that declares none inherits from its nearest ancestor directory that has one: the directories' paths are
   unfolded into ancestors and joined. A page's host is its outermost directory, so nothing goes from host to host.

Texts are read once, for their headers, which are written; texts are never shuffled, and distinct headers are scored
once, however many files hold them. The templates' words are a table of fixed size.

Defined results. A null or empty text declares nothing. A null path is in no directory: it can declare, not inherit.
Rows that share a path are one file: all get the best of their texts. A path without "/" is in the outermost directory.
Very long texts are cut whole. An empty table gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .license_texts import DISTINGUISHING, FORMS, NAMES, NOTICES, WHOLE

LEAST, LEAST_WHOLE = 0.6, 0.8
CUE = r"(?i)licen[sc]e|copyright|permission|redistribut|warrant|public domain|spdx|cc by"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|legal)[^/]*$"
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"

#: Signs at the beginning of a comment's line.
_SIGNS = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+)[ \t]*"

#: (license, whole or not, template)
TEMPLATES = tuple((i, False, form.format(id=i, name=name)) for i, name in NAMES for form in FORMS) + tuple((i, False, t) for i, t in NOTICES) + tuple((i, True, t) for i, t in WHOLE)


def _words(text: str) -> Counter:
    return Counter(re.sub(r"\.0$", "", w) for w in re.findall(_TOKEN, text.lower()))


@cache
def _weights() -> tuple[list[tuple[str, bool, int, str, float, str]], dict[str, float], float]:
    """(license, whole, template, word, unit weight, distinguishing words), idf of each word, and idf of other words."""
    counts = [_words(text) for _, _, text in TEMPLATES]
    held = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / n) for w, n in sorted(held.items())}
    rows = []
    for k, ((license, whole, _), c) in enumerate(zip(TEMPLATES, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        marks = " ".join(sorted(set(c) & set(DISTINGUISHING)))
        rows += [(license, whole, k, w, n * idf[w] / norm, marks) for w, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(counts))


def _fixed(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from one literal, so that no Python worker is needed."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def headers(text: Column) -> Column:
    """The sentences of a text's lines and paragraphs that hold a cue word."""
    plain = F.regexp_replace(text, _SIGNS, "")
    paragraphs = F.transform(F.split(plain, r"\n[ \t]*\n"), lambda p: F.regexp_replace(F.trim(p), r"[ \t]*\n[ \t]*", " "))
    parts = F.concat(F.split(plain, "\n"), paragraphs)
    cut_up = F.split(F.regexp_replace(F.array_join(F.filter(parts, lambda s: s.rlike(CUE)), "\n"), r"([.!?]) +([A-Z])", "$1\n$2"), "\n")
    return F.array_distinct(F.filter(F.transform(cut_up, lambda s: F.trim(s)), lambda s: s.rlike(CUE)))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def header_scores(found: DataFrame) -> DataFrame:
    """print, license, score: the best template of each distinct header(print, whole, header), if it is near enough."""
    spark = found.sparkSession
    weights, idf, other = _weights()
    words = _fixed(spark, list(idf.items()), "word string, idf double")
    unit = _fixed(spark, weights, "license string, whole boolean, template int, word string, unit double, marks string")
    tokens = F.transform(F.regexp_extract_all(F.lower("header"), F.lit(_TOKEN), 0), lambda w: F.regexp_replace(w, r"\.0$", ""))
    split = found.groupBy("print", "whole").agg(F.min("header").alias("header")).select("print", "whole", tokens.alias("words"))
    own = F.array_join(F.array_sort(F.array_intersect("words", F.array(*map(F.lit, DISTINGUISHING)))), " ")
    # Kept before it is unfolded, so that no row carries a whole header along.
    told = cut(split.select("print", "whole", own.alias("own"), "words"))
    terms = told.select("print", "whole", "own", F.explode("words").alias("word")).groupBy("print", "whole", "own", "word").agg(F.count("*").alias("n"))
    weighed = cut(terms.join(F.broadcast(words), "word", "left").select("print", "whole", "own", "word", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("w")))
    norms = weighed.groupBy("print", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(unit), ["word", "whole"]).where("whole or own = marks").groupBy("print", "whole", "license", "template").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, ["print", "whole"]).select("print", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), F.when(F.col("whole"), F.lit(LEAST_WHOLE)).otherwise(F.lit(LEAST)).alias("least")).where("score >= least")
    best = scored.groupBy("print").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
    return best.select("print", F.col("best.license").alias("license"), (-F.col("best.less")).alias("score"))


def scan_licenses(files: DataFrame) -> DataFrame:
    """id, path, license, score, how (header, inherited or none) and source_path of each row of files(id, path, text)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("path")), F.concat(F.lit("?"), F.col("id").cast("string")), F.lit("?"))
    rows = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).withColumn("key", key)
    part = lambda whole, header: F.struct(F.lit(whole).alias("whole"), header.alias("header"))
    named = F.when(F.col("path").rlike(LICENCE_FILE), F.array(part(True, F.col("text")))).otherwise(F.array().cast("array<struct<whole:boolean,header:string>>"))
    parts = F.concat(named, F.transform(headers(F.col("text")), lambda h: part(False, h)))
    found = cut(rows.where(F.col("text").rlike(CUE)).select("key", "path", F.inline(parts)).withColumn("print", F.md5(F.concat(F.col("whole").cast("string"), "header"))).distinct())
    scored = found.select("key", "path", "print").join(header_scores(found.select("print", "whole", "header")), "print")
    declared = scored.groupBy("key").agg(F.first("path").alias("path"), F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best")).select("key", "path", F.col("best.license").alias("license"), (-F.col("best.less")).alias("score"))
    in_file = F.col("path").rlike(LICENCE_FILE)
    named = declared.where("path is not null").withColumn("dir", directory(F.col("path"))).groupBy("dir").agg(F.min(F.when(in_file, F.struct((-F.col("score")).alias("less"), "license"))).alias("file"), F.min("license").alias("low"), F.max("license").alias("high"))
    licensed = named.select("dir", F.coalesce(F.col("file.license"), F.when(F.col("low") == F.col("high"), F.col("low"))).alias("license")).where("license is not null")
    parts = F.split("dir", "/")
    above = rows.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct().select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("ancestor")).distinct()
    nearest = above.join(licensed.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("license", "ancestor"), F.length("ancestor")).alias("near"))
    every = rows.select("id", "path", "key", directory(F.col("path")).alias("dir"))
    joined = every.join(declared.select("key", "license", "score"), "key", "left").join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    how = F.when(own, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return joined.select("id", "path", F.coalesce("license", "near.license").alias("license"), "score", how.alias("how"), F.when(own, F.col("path")).otherwise(F.col("near.ancestor")).alias("source_path"))


def page_files(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as files(id, path, text): the URL's host and path, and the page without tags."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    path = F.when(F.contains(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))  # the host is a directory
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "\n"), "<[^>]*>", "\n")
    return pages.select(F.col("page_id").alias("id"), path.alias("path"), text.alias("text"))


def scan_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return scan_licenses(page_files(pages)).withColumnRenamed("id", "page_id")


def scan_pages_sql() -> str:
    """scan_pages in DuckDB's SQL."""
    weights, idf, other = _weights()
    words = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    unit = ", ".join(f"('{a}', {whole}, {k}, '{w}', {x!r}::DOUBLE, '{marks}')" for a, whole, k, w, x, marks in weights)
    folder = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '' END"
    bare = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
    marks = ", ".join(f"'{w}'" for w in DISTINGUISHING)
    best = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY score DESC, license) = 1"
    return f"""
WITH words(word, idf) AS (VALUES {words}),
units(license, whole, template, word, unit, marks) AS (VALUES {unit}),
files AS (
  SELECT page_id, CASE WHEN contains({bare}, '/') THEN {bare} ELSE {bare} || '/' END AS path,
         regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS text
  FROM pages),
keyed AS (SELECT *, coalesce('=' || path, '?' || page_id, '?') AS key, {folder} AS dir FROM files),
plain AS (SELECT key, path, regexp_replace(text, '{_SIGNS}', '', 'g') AS text FROM keyed WHERE regexp_matches(text, '{CUE}')),
parts AS (
  SELECT key, path, unnest(string_split(text, chr(10))) AS part FROM plain
  UNION ALL
  SELECT key, path, regexp_replace(trim(part), '[ \t]*\n[ \t]*', ' ', 'g')
  FROM (SELECT key, path, unnest(string_split_regex(text, '\n[ \t]*\n')) AS part FROM plain)),
sentences AS (SELECT key, path, trim(unnest(string_split(regexp_replace(part, '([.!?]) +([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10)))) AS header FROM parts WHERE regexp_matches(part, '{CUE}')),
found AS (
  SELECT DISTINCT key, path, false AS whole, header FROM sentences WHERE regexp_matches(header, '{CUE}')
  UNION SELECT key, path, true, text FROM keyed WHERE regexp_matches(path, '{LICENCE_FILE}') AND regexp_matches(text, '{CUE}')),
split AS (
  SELECT whole, header, list_transform(regexp_extract_all(lower(header), '{_TOKEN}'), lambda w: regexp_replace(w, '\\.0$', '')) AS words
  FROM (SELECT DISTINCT whole, header FROM found)),
terms AS (
  SELECT whole, header, own, word, count(*) AS n
  FROM (SELECT whole, header, array_to_string(list_sort(list_distinct(list_filter(words, lambda w: w IN ({marks})))), ' ') AS own, unnest(words) AS word FROM split) GROUP BY ALL),
weighed AS (SELECT whole, header, own, word, n * coalesce(idf, {other!r}::DOUBLE) AS w FROM terms LEFT JOIN words USING (word)),
norms AS (SELECT whole, header, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT whole, header, license, template, sum(w * unit) AS dot FROM weighed JOIN units USING (word, whole) WHERE whole OR own = marks GROUP BY ALL),
scored AS (SELECT whole, header, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (whole, header) WHERE round(dot / norm, 6) >= CASE WHEN whole THEN {LEAST_WHOLE} ELSE {LEAST} END),
best AS (SELECT * FROM scored {best.format('whole, header')}),
declared AS (SELECT key, path, license, score FROM found JOIN best USING (whole, header) {best.format('key')}),
named AS (
  SELECT {folder} AS dir, arg_max(license, score) FILTER (regexp_matches(path, '{LICENCE_FILE}')) AS file, min(license) AS low, max(license) AS high
  FROM declared WHERE path IS NOT NULL GROUP BY 1),
licensed AS (SELECT dir, coalesce(file, CASE WHEN low = high THEN low END) AS license FROM named WHERE coalesce(file, CASE WHEN low = high THEN low END) IS NOT NULL),
above AS (
  SELECT DISTINCT dir, unnest([''] || list_transform(range(1, len(string_split(dir, '/')) + 1), lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS ancestor
  FROM (SELECT DISTINCT dir FROM keyed WHERE path IS NOT NULL)),
nearest AS (
  SELECT a.dir, license, ancestor FROM above a JOIN licensed l ON a.ancestor = l.dir
  QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(ancestor) DESC) = 1)
SELECT page_id, k.path, coalesce(d.license, n.license) AS license, score,
       CASE WHEN d.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN d.license IS NOT NULL THEN k.path ELSE n.ancestor END AS source_path
FROM keyed k LEFT JOIN declared d USING (key) LEFT JOIN nearest n ON k.dir = n.dir"""
