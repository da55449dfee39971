"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query (`trigrams`). The index has a posting (trigram, doc_id) for
each distinct trigram of a text that some query asks for: the text is read once, its trigrams taken from left to right. A
query's alternatives are intersections of postings: the documents that have as many of an alternative's
trigrams as it lists. Those are the rule's candidates; only they are scanned with it. Rules
without mandatory trigrams scan all documents. Texts are shuffled once, to meet their candidate rules.

Spans come from splitting the text at the rule's matches: the pieces between and the matches themselves give the
offsets, in code points. Sums of lengths are taken by blocks of `BLOCK` matches, so a text with very many matches
costs little more than its length. Matches that fail the rule's length are dropped.

Defined cases: a null text is empty; an empty one has no spans; rows that repeat a doc_id each get their own spans; a null
doc_id is a document as any other. Other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of `pattern` whose `group` has `least` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0


# The rules that the base result consists of.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Rules beyond the base.
EXTRA = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{30,}", 34),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 27),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 20),
)


#: Matches whose lengths are summed together.
BLOCK = 128


def queries(rules: tuple[Rule, ...]) -> dict[str, list[list[str]]]:
    """Each rule's trigram query, by kind."""
    return {r.kind: trigram_query(r.pattern) for r in rules}


def _any_of(grams: list[str]) -> str:
    """A pattern that captures, at each place where one begins, the trigram that is there."""

    def plain(text: str) -> str:
        return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)

    heads: dict[str, dict[str, list[str]]] = {}
    for x, y, z in sorted(grams):
        heads.setdefault(x, {}).setdefault(y, []).append(z)
    branches = []
    for x, rest in heads.items():
        ends = [plain(y) + (plain(z[0]) if len(z) == 1 else "[" + "".join(map(plain, z)) + "]") for y, z in rest.items()]
        branches.append(plain(x) + (ends[0] if len(ends) == 1 else "(?:" + "|".join(ends) + ")"))
    return "(?=(" + "|".join(branches) + "))"


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Rows gram, doc_id: which documents have which of these trigrams (folded to lower case)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(grams)), F.lit(1)))
    return docs.select("doc_id", F.explode(found).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows _id, kinds: for each document that is a candidate of some rule, those rules."""
    asked = [(r, n, alt) for r, q in queries(rules).items() if q != [[]] for n, alt in enumerate(q)]
    grams = sorted({g for _, _, alt in asked for g in alt})
    if not grams:
        return docs.select(F.col("doc_id").alias("_id"), F.array().cast("array<string>").alias("kinds")).limit(0)
    index = postings(docs, grams)
    # Which alternatives ask for a trigram: a literal of the rules' size.
    wants = F.create_map(
        *[
            x
            for g in grams
            for x in (F.lit(g), F.array(*[F.lit(f"{r}/{n}/{len(alt)}") for r, n, alt in asked if g in alt]))
        ]
    )
    hits = index.select("doc_id", "gram", F.explode(wants[F.col("gram")]).alias("want"))
    met = hits.groupBy("doc_id", "want").agg(F.count_distinct("gram").alias("have"))
    met = met.where(F.col("have") == F.split_part("want", F.lit("/"), F.lit(3)).cast("long"))
    return met.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.split_part("want", F.lit("/"), F.lit(1))).alias("kinds"))


def _starts(steps: str) -> str:
    """SQL: for each struct (gap, size) where its match starts. Sums within blocks go on from the sums of the blocks before."""
    of_block = "aggregate(b, 0, (n, x) -> n + x.gap + coalesce(x.size, 0))"
    before = "transform(sequence(0, size(sums) - 1), k -> aggregate(slice(sums, 1, k), 0, (n, x) -> n + x))"
    inside = (
        "aggregate(b, named_struct('at', start, 'out', cast(array() as array<int>)),"
        " (s, x) -> named_struct('at', s.at + x.gap + coalesce(x.size, 0), 'out', array_append(s.out, s.at + x.gap)), s -> s.out)"
    )
    return (
        f"transform(array({steps}), all -> transform(array(transform(sequence(0, (size(all) - 1) div {BLOCK}), k -> slice(all, k * {BLOCK} + 1, {BLOCK}))),"
        f" blocks -> transform(array(transform(blocks, b -> {of_block})), sums -> flatten(zip_with(blocks, {before}, (b, start) -> {inside})))[0])[0])[0]"
    )


def spans(text: str, rule: Rule) -> Column:
    """The rule's spans in the column `text`: an array of structs start, stop, kind."""
    p = "'" + _long(rule).replace("\\", "\\\\").replace("'", "\\'") + "'"
    whole = f"transform(regexp_extract_all({text}, {p}, 0), x -> length(x))"
    part = f"transform(regexp_extract_all({text}, {p}, {rule.group}), x -> length(x) >= {rule.least})"
    between = f"transform(split({text}, {p}, -1), x -> length(x))"
    steps = f"zip_with({between}, {whole}, (a, b) -> named_struct('gap', a, 'size', b))"
    placed = f"transform(array({whole}), w -> zip_with(slice({_starts(steps)}, 1, size(w)), w, (a, n) -> named_struct('start', a, 'stop', a + n)))[0]"
    kept = f"filter(zip_with({placed}, {part}, (s, ok) -> named_struct('start', s.start, 'stop', s.stop, 'ok', ok)), x -> x.ok)"
    return F.expr(f"transform({kept}, x -> named_struct('start', x.start, 'stop', x.stop, 'kind', '{rule.kind}'))")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """Rows doc_id and a column of spans (structs start, stop, kind) for each rule, named by its kind."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = candidates(own, rules)
    seen = own.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    everywhere = {k for k, q in queries(rules).items() if q == [[]]}
    out = []
    for r in rules:
        # A full scan first asks, without taking the text apart, whether there is a match.
        due = F.col("text").rlike(_long(r)) if r.kind in everywhere else F.array_contains("kinds", r.kind)
        out.append(F.coalesce(F.when(due, spans("text", r)), none).alias(r.kind))
    return seen.select("doc_id", *out)


def _long(rule: Rule) -> str:
    """A pattern with the rule's spans that passes over most that are too short.

    Where the rule is letters and then any number from a set that has those letters, only a whole run of the set can be long enough from a
    place inside it; so the length goes into the pattern. From a set alone a match begins where a run begins.
    """
    plain = re.fullmatch(r"([A-Za-z0-9]*)(\[[A-Za-z0-9-]+\])\+", rule.pattern)
    if not plain or rule.group or not re.fullmatch(plain[2] + "*", plain[1]):
        return rule.pattern
    start = "" if plain[1] else f"(?<!{plain[2]})"
    return start + plain[1] + plain[2] + "{" + str(rule.least - len(plain[1])) + ",}"


def listed(kinds: list[str]) -> Column:
    """kind:start:stop of the spans of these kinds by start, then kind as listed, joined by commas."""
    ranked = [F.transform(F.col(k), lambda x, n=n: F.struct(x["start"], F.lit(n).alias("nth"), x["stop"], x["kind"])) for n, k in enumerate(kinds)]
    every = F.sort_array(F.concat(*ranked))
    return F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
