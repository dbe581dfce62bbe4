"""Secret scans through a trigram inverted index, in DataFrame operations only.

A Boolean trigram query is derived from each rule's regular expression. The index maps the trigrams
that some query names to the documents with them; postings are intersected to the documents that
satisfy a query, and only those are verified by the expressions. A rule without a mandatory
trigram, such as a run of hexadecimal digits, scans every document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm import bitmap
from cuelake.llm.trigrams import Query, named, query_of
from cuelake.llm.workdir import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``regex`` finds it; ``least`` is the length that ``group`` needs for a match to count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = field(default=False)

    def query(self) -> Query:
        return query_of(self.regex)


#: The three patterns of the contract, in the order of its list.
BASE_RULES = (
    Rule("assign", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
)
#: What the method adds: well-known token forms.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


def index(docs: DataFrame, key: str, text: str, grams: Sequence[str]) -> DataFrame:
    """The inverted index: (gram, key) for each trigram and each document that holds it, capitals made small."""
    small = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds = docs.select(F.col(key).alias("key"), small.alias("small")).select("key", *[F.col("small").contains(g).alias(f"g{i}") for i, g in enumerate(grams)])
    return holds.select("key", F.explode(F.filter(F.array(*[F.when(F.col(f"g{i}"), F.lit(g)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())).alias("gram"))


def candidates(postings: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(key): the documents that satisfy one of the queries.

    Postings meet the conjunctions that name their trigram (a small table, as large as the rules);
    a document is in the intersection of a conjunction's postings if it has a posting of each of its
    trigrams. These are counted by document, joined before the shuffle, so a trigram that most
    documents hold makes no large group.
    """
    parts = sorted({tuple(sorted(part)) for q in queries for part in q})
    rows = [F.struct(F.lit(g).alias("gram"), F.lit(n).alias("part"), F.lit(1 << i % 60).cast("long").alias("bit"), F.lit(i // 60).alias("word"), F.lit(len(part)).alias("size")) for n, part in enumerate(parts) for i, g in enumerate(part)]
    words = -(-max(map(len, parts)) // 60)
    named_by = postings.sparkSession.range(1).select(F.inline(F.array(*rows)))
    met = postings.join(F.broadcast(named_by), "gram")
    held = met.groupBy("key", "part").agg(F.max("size").alias("size"), *[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"held{w}") for w in range(words)])
    return held.where(sum((F.bit_count(f"held{w}") for w in range(words)), F.lit(0)) == F.col("size")).select("key").distinct()


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def in_slices(values: Column) -> Column:
    """An array cut into slices, as many as each is long."""

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int") - 1), lambda i: F.slice(v, i * w + 1, w)))

    return _let(values, cut)


def before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of a non-empty array of numbers, 0 and all earlier elements joined.

    A fold that appends to an array copies it at every step. So it runs over slices, and once over
    what each slice comes to: n times the root of n instead of n squared.
    """
    zero, none = F.lit(0), F.array().cast("array<int>")

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.struct(zero.alias("now"), none.alias("out")), lambda a, x: F.struct(join(a.now, x).alias("now"), F.concat(a.out, F.array(a.now)).alias("out"))).out

    def whole(slices: Column) -> Column:
        starts = fold(F.transform(slices, lambda part: F.aggregate(part, zero, join)))
        return F.flatten(F.zip_with(slices, starts, lambda part, start: F.transform(fold(part), lambda x: join(start, x))))

    return _let(in_slices(values), whole)


def spans_of(text: Column, rule: Rule) -> Column:
    """array(struct(start, end)) of a rule's leftmost non-overlapping matches that are long enough, in code points."""

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule.regex, -1), 1, F.size(matches)), F.length)
        sizes = F.transform(matches, F.length)
        held = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.length) if rule.group else sizes
        rows = F.arrays_zip(before(F.zip_with(gaps, sizes, lambda g, m: g + m), lambda a, b: a + b).alias("before"), gaps.alias("gap"), sizes.alias("size"), held.alias("held"))
        return F.transform(F.filter(rows, lambda r: r.held >= rule.least), lambda r: F.struct((r.before + r.gap).alias("start"), (r.before + r.gap + r["size"]).alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return _let(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), lambda matches: F.when(F.size(matches) > 0, placed(matches)).otherwise(none))


def long_runs(text: Column, one: str, least: int) -> Column:
    """Spans of runs of characters of a class; a maximal run is a match, so short ones need not be matched at all."""
    return spans_of(text, Rule("run", f"{one}{{{least},}}"))


def find(text: Column, rule: Rule) -> Column:
    """Typed spans of one rule: array(struct(kind_no, kind, start, end))."""
    if rule.kind == "hex":
        found = F.when(text.rlike(f"[0-9a-f]{{{rule.least}}}"), long_runs(text, "[0-9a-f]", rule.least))
    elif rule.kind == "access":  # a match goes on to the end of its run, so the length can be asked for at once
        found = spans_of(text, Rule("access", f"AKIA[A-Z0-9]{{{rule.least - 4},}}"))
    else:
        found = spans_of(text, rule)
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: array(struct(start, kind_no, end, kind, base)) by start, then kind (a column of this name is replaced).

    Offsets are code points, end exclusive. Texts are scanned as a whole; null and empty texts
    have no secret. The ids of candidates are written and come back to the texts as a bitmap of
    hashes (64 MB at most), so no text is shuffled. Rows that share an id share the index's answer,
    which lets pass more rows than needed but never fewer; so do rows with a null id. An empty
    table gives an empty result.
    """
    queries = [r.query() for r in rules]
    key = F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "secrets"]
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    with Scratch(docs.sparkSession, "secrets") as scratch:
        if any(queries):
            hits = scratch.save(candidates(index(rows, "key", "text", named(queries)), queries), "candidates")
            rows = bitmap.flagged(rows, hits, F.col("key"), bitmap.buckets_for(hits.count()), "candidate")

        def typed(n: int, rule: Rule) -> Column:
            return F.transform(find(F.col("text"), rule), lambda s: F.struct(s.start.alias("start"), F.lit(n).alias("kind_no"), s.end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base")))

        none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,base:boolean>>")
        found = [F.when(F.col("candidate"), typed(n, r)).otherwise(none) if q else typed(n, r) for n, (r, q) in enumerate(zip(rules, queries, strict=True))]
        return scratch.keep(rows.select("row.*", F.array_sort(F.concat(*found)).alias("secrets")))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each secret replaced by ``[kind]``; of overlapping spans the first by start covers what it covers, later ones the rest.

    Finding a place in a text takes as long as the text up to there, so gaps are cut out of slices
    of the text.
    """

    def piece(part: Column, base: Column, s: Column) -> Column:
        gap = F.when(s.start > s["at"], F.substring(part, s["at"] - base + 1, s.start - s["at"])).otherwise(F.lit(""))
        return F.concat(gap, F.when(s.end > s["at"], F.concat(F.lit("["), s.kind, F.lit("]"))).otherwise(F.lit("")))

    def cut(some: Column) -> Column:
        base = F.get(some, 0)["at"]
        return _let(F.substring(text, base + 1, F.greatest(F.element_at(some, -1).start - base, F.lit(0))), lambda part: F.array_join(F.transform(some, lambda s: piece(part, base, s)), ""))

    covered = before(F.transform(spans, lambda s: s.end), lambda a, b: F.greatest(a, b))
    rows = F.zip_with(spans, covered, lambda s, at: F.struct(at.alias("at"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    done = _let(rows, lambda r: F.array_join(F.transform(in_slices(r), cut), ""))
    return F.when(F.size(spans) > 0, F.concat(done, F.substring(text, F.array_max(F.transform(spans, lambda s: s.end)) + 1, F.length(text)))).otherwise(text)
