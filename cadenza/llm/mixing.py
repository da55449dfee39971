"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is a share of `SHARE` times all words, by weight, at most `MOST` times its own
words; what it can't take goes to the others by weight until none is above. A document is then
to be copied target / source_size times: always the whole part of that, and once more with the
fractional part as its probability. The pivotal method rounds those probabilities: two units at a time, it moves mass
(probability times words) from one to the other until one of them is 0 or 1, the direction at random
so that each keeps its expectation; the other goes on. The words of a pair are the same before
and after, so a source's total misses its target only by the last unit's rounding.

Units are dealt into blocks of about `FAN` by a hash of the id; a block is folded in one row, and its one
unit left over goes up to the next level, a reduction tree of depth log_FAN(n). A hot source
just has more blocks. Levels are written tables, so a lost executor costs one level at most.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, after
all others; rows that repeat an id, source and size are decided together (each is taken as
often as the others); an empty table gives no rows. Columns beyond doc_id, text and source don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import join_dealt, keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Units that a block of the reduction tree has on average.
FAN = 48


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and line or page breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Rows source, source_size, target. The windows run over sources, not over documents."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    ranked = total.select("source", "source_size", weight.cast("double").alias("w"))
    # The level at which a source is full rises with its cap over its weight; below the last full source all get the same level.
    cap = F.col("source_size") * most
    rise = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").cast("binary").asc_nulls_last())
    upto = rise.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ranked.select(
        "*",
        cap.alias("cap"),
        (F.sum("source_size").over(whole) * share).alias("all"),
        F.coalesce(F.sum(cap).over(upto), F.lit(0.0)).alias("full"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).alias("w_rest"),
    ).withColumn("level", (F.col("all") - F.col("full")) / F.col("w_rest"))
    # The first source in that order that its share does not fill sets the level; all after it would get less.
    final = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    target = F.least("cap", F.coalesce(final * F.col("w"), F.col("cap")))
    return level.select("source", "source_size", target.alias("target"))


def _fold(seed: int) -> str:
    """SQL over `units` (sorted structs id, src, size, m, p): one left over (or null) and the decided ones."""
    one, two = "s.rest", "x"
    mass1, mass2 = f"{one}.p * {one}.words", f"{two}.p * {two}.words"
    down = f"least({mass1}, {two}.words - {mass2})"  # from the first to the second
    up = f"least({mass2}, {one}.words - {mass1})"
    coin = f"(xxhash64({one}.doc_id, {one}.size, {two}.doc_id, {two}.size, {seed}) & 9007199254740991) / 9007199254740992D"
    moved = f"if({coin} * ({down} + {up}) < {up}, -({down}), {up})"

    def unit(of: str, p: str) -> str:
        return f"named_struct('words', {of}.words, 'doc_id', {of}.doc_id, 'size', {of}.size, 'm', {of}.m, 'p', {p})"

    def near(p: str) -> str:
        return f"(case when {p} < 1e-9D then 0D when {p} > 1 - 1e-9D then 1D else {p} end)"

    both = (
        f"transform(array({moved}), d -> named_struct("
        f"'a', {unit(one, near(f'{one}.p + d / {one}.words'))}, 'b', {unit(two, near(f'{two}.p - d / {two}.words'))}))[0]"
    )
    whole = "(y.{0}.p = 0D or y.{0}.p = 1D)"
    step = (
        f"transform(array({both}), y -> named_struct("
        f"'rest', case when not {whole.format('a')} then y.a when not {whole.format('b')} then y.b end,"
        f"'done', concat(s.done, filter(array(y.a, y.b), z -> z.p = 0D or z.p = 1D))))[0]"
    )
    none = "cast(null as struct<words:double,doc_id:bigint,size:bigint,m:bigint,p:double>)"
    start = f"named_struct('rest', {none}, 'done', cast(array() as array<struct<words:double,doc_id:bigint,size:bigint,m:bigint,p:double>>))"
    return f"aggregate(units, {start}, (s, x) -> if(s.rest is null, named_struct('rest', x, 'done', s.done), {step}))"


def pivotal(units: DataFrame, seed: int = 0, fan: int = FAN) -> DataFrame:
    """Rounds the units' p within each src: rows src, doc_id, size, up (0 or 1).

    `units` has src, doc_id, size, m (rows it stands for), words (double) and p in (0, 1).
    """
    now, decided, level = units, [], 0
    shape = ["src", "doc_id", "size", "m", "words", "p"]
    most = now.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    while most:
        blocks = now.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / fan).alias("n")).withColumnRenamed("src", "_src")
        dealt = now.join(blocks, F.col("src").eqNullSafe(F.col("_src")))
        block = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("n"))
        packed = dealt.groupBy("src", block.alias("block")).agg(
            F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ("words", "doc_id", "size", "m", "p")])), False).alias("units")
        )
        folded = keep(packed.select("src", F.expr(_fold(seed + level)).alias("s")), f"pivotal-{level}")
        decided.append(folded.select("src", F.explode("s.done").alias("u")).select("src", "u.doc_id", "u.size", F.col("u.p").cast("long").alias("up")))
        now = folded.where("s.rest is not null").select("src", "s.rest.*").select(*shape)
        left = now.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        level += 1
        if left <= 1 or (left == most and level > 40):
            break
        most = left
    if most:
        coin = (F.xxhash64("src", "doc_id", "size", F.lit(seed - 1)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
        decided.append(now.select("src", "doc_id", "size", F.when(coin < F.col("p"), 1).otherwise(0).cast("long").alias("up")))
    out = decided[0] if decided else units.select("src", "doc_id", "size", F.lit(0).cast("long").alias("up"))
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """Rows doc_id, source, size, source_size, target, copies, taken for each document."""
    sized = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
        )
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("m")),
        "sizes",
    )
    targets = keep(source_targets(sized.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most), "targets")
    goal = targets.select(F.col("source").alias("_src"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = sized.join(goal, F.col("source").eqNullSafe(F.col("_src")), "left").withColumn("ratio", ratio).drop("_src")
    base = F.floor(F.col("ratio") + 1e-12)
    part = F.col("ratio") - base
    open_ = aimed.where((F.col("size") > 0) & (part > 1e-9)).select(
        F.col("source").alias("src"), "doc_id", "size", "m", (F.col("size") * F.col("m")).cast("double").alias("words"), part.alias("p")
    )
    ups = pivotal(open_, seed).select(F.col("src").alias("_src"), F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), "up")
    same = F.col("source").eqNullSafe(F.col("_src")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size"))
    copies = F.when(F.col("size") > 0, base + F.coalesce("up", F.lit(0))).otherwise(0).cast("long")
    done = join_dealt(aimed, ups, same, "left").withColumn("copies", copies)
    each = F.explode(F.expr("sequence(1L, m)"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), each.alias("_n")).drop("_n")
