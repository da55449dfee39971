"""The queries opN_<name> over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, fingerprint, linededup, lm, mixing, neardup, pii, quality, secrets, toxicity
from ._io import table

#: The key of the pseudonyms of op4; production passes its own secret.
PII_KEY = b"cadenza pseudonyms"
THRESHOLD = toxicity.THRESHOLD


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.classes(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_pii(table(spark, folder, "documents"), PII_KEY)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    report = linededup.line_report(table(spark, folder, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _judged(scored: DataFrame, parts: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.in_fold("doc_id", parts, held), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return _judged(quality.score(docs, quality.train(docs, table(spark, folder, "labels"))), 5, 0)


def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm.score_documents(table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", F.round("log10_sum", 3).alias("log10_sum"), F.round("score", 6).alias("score"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprint.fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = [r.kind for r in secrets.BASE]
    every = base + [r.kind for r in secrets.EXTRA]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(every).alias("spans"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return _judged(toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels"))), 4, 2)


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
with doc as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
item as (select item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as words
        from item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select distinct size from win),
gram as (select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as words
         from doc, sizes, unnest(range(1, len(w) - size + 2)) as t(i) where len(w) >= size),
met as (select g.doc_id, g.i, g.size, v.item_id from gram g join win v using (size, words)),
hit as (select doc_id, count(distinct k) as n from met, unnest(range(i, i + size)) as t(k) group by doc_id),
items as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from met group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""

OP3_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (select distinct doc_id, hash(array_to_string(w[i : i + 4], ' '), least(len(w), 5)) as s from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b using (s) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (select a, a from edge union select r.doc_id, e.b from reach r join edge e on e.a = r.other),
comp as (select doc_id, min(other) as c from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join comp using (doc_id)
"""

OP5_SQL = f"""
with line as (select doc_id, i, lines[i] as line, {_ASCII_LOWER.format(f"trim(lines[i], {_BLANKS})")} as key
              from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), unnest(range(1, len(lines) + 1)) as t(i)),
often as (select key, max(doc_id) as last from line where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select line.*, last is not null and doc_id <> last as gone from line left join often using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


OP7_SQL = f"""
with doc as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
token as (select doc_id, i, w[i] as word, w[i + 1] as after from doc, unnest(range(1, len(w) + 1)) as t(i)),
one as (select word, count(*) as c from token group by word),
total as (select count(*) as tokens from token),
own as (select doc_id, word, after, count(*) as n from token where after is not null group by doc_id, word, after),
two as (select word, after, sum(n) as c from own group by word, after),
part as (select doc_id, n * log10(case when two.c > n then two.c / x.c else 0.4 * y.c / tokens end) as s
         from own join two using (word, after) join one x on x.word = own.word join one y on y.word = own.after, total
         union all select doc_id, log10(c / tokens) from token join one using (word), total where i = 1),
score as (select doc_id, sum(s) as s from part group by doc_id)
select doc_id, len(w)::bigint as n_words, round(s, 3) as log10_sum, round(s / len(w), 6) as score from doc left join score using (doc_id)
"""


# Projections of op2, op8 and op9 to what SQL can say: a second check of those columns.


def mixing_targets(spark: SparkSession, folder: str) -> DataFrame:
    return op2_mixing(spark, folder).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


def fingerprint_texts(spark: SparkSession, folder: str) -> DataFrame:
    return op8_fingerprints(spark, folder).select("doc_id", "n_chars", "edited_sha256")


def secret_base(spark: SparkSession, folder: str) -> DataFrame:
    return op9_secrets(spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


MIXING_TARGETS_SQL = """
with doc as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
src as (select source, sum(size) as s, row_number() over (order by source is null, encode(source)) as nth from doc group by source),
w as (select source, s, 2.0 * s as cap, [3, 1, 2][((nth - 1) % 3 + 1)::int]::double as w from src),
goal as (select 1.5 * sum(s) as t from w),
-- Filled to a level l, the sources take sum(least(cap, l * w)); it has a kink where a source is full.
kink as (select x.cap / x.w as l, sum(least(y.cap, x.cap / x.w * y.w)) as takes from w x, w y group by x.source, x.cap, x.w),
part as (select coalesce(max(l) filter (where takes <= t), 0) as low from kink, goal),
level as (select max(low) + (max(t) - sum(least(cap, low * w))) / nullif(sum(w) filter (where cap / w > low), 0) as l from w, part, goal)
select doc_id, size, s::bigint as source_size, round(least(cap, coalesce(l, low) * w), 3) as target, true as within
from doc join w on w.source is not distinct from doc.source, level, part
"""

FINGERPRINT_TEXTS_SQL = """
with doc as (select doc_id, coalesce(text, '') as t from documents),
pair as (select doc_id, t, length(t) as n, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as after from doc)
select doc_id, n::bigint as n_chars, sha256(substr(t, 1, n - n // 4) || substr(after, 1, n // 4)) as edited_sha256 from pair
"""

_ASSIGN = secrets.BASE[0].pattern.replace("'", "''")
SECRET_BASE_SQL = f"""
with doc as (select doc_id, coalesce(text, '') as t from documents),
rule as (select * from (values (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32)) r(nth, kind, least)),
cut as (
  select doc_id, 0 as nth, string_split_regex(t, '{_ASSIGN}') as p, regexp_extract_all(t, '{_ASSIGN}', 0) as m, regexp_extract_all(t, '{_ASSIGN}', 2) as g from doc
  union all select doc_id, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') from doc
  union all select doc_id, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') from doc),
one as (select doc_id, nth, i, length(p[i]) as gap, length(m[i]) as n, length(g[i]) as size from cut, unnest(range(1, len(m) + 1)) as x(i)),
placed as (select *, sum(gap + n) over (partition by doc_id, nth order by i) as stop from one),
span as (select doc_id, nth, kind, (stop - n)::bigint as start, stop::bigint as stop from placed join rule using (nth) where size >= least)
select doc_id, count(*) filter (where nth = 0) as n_assign, count(*) filter (where nth = 1) as n_access, count(*) filter (where nth = 2) as n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, nth), '')) as base_sha256
from doc left join span using (doc_id) group by doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontamination, op2_mixing, op3_near_dedup, op4_pii, op5_line_dedup,
        op6_quality, op7_lm_scores, op8_fingerprints, op9_secrets, op10_toxicity,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (mixing_targets, fingerprint_texts, secret_base)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL, "op3_near_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_lm_scores": OP7_SQL,
        "mixing_targets": MIXING_TARGETS_SQL, "fingerprint_texts": FINGERPRINT_TEXTS_SQL, "secret_base": SECRET_BASE_SQL,
    }
