"""Personal data: fixed patterns, and identifiers that stand in the same contexts.

The fixed patterns find spans of four kinds.  Contexts of these spans, the two words before, are the lexical patterns
that seeds induce; whatever token with a digit or an at sign stands in such a context elsewhere is a candidate.  Cards
and phones are often written in groups, so a candidate for them runs on over the groups of digits that follow.  Spark
scores the graph of contexts and tokens iteratively: a context is as good for a kind as the share of its occurrences
that known or likely tokens of the kind fill; a token is as likely as its contexts together make it (noisy or).  A
context is borne out by enough different tokens that are seeds or that other such contexts make likely.  In the end
candidates in contexts that are good and borne out are added as spans of the kind, and so are the other occurrences of
tokens that such contexts make likely, if the token is long enough to tell (see TELLING).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, kept, map_batches, record, text_of

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the four kinds.  Possessive and with a look-behind where a later start within the same
# run can't match either, so that the time stays linear.
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER = re.compile(r"[0-9]++")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*+")
_EDGE = ".,;:!?()[]{}<>\"'"

CARD, PHONE = KINDS.index("card"), KINDS.index("phone")
#: Digits of a candidate for the kinds that are written in groups, at most; as in their base patterns.
GROUPED = {CARD: 19, PHONE: 15}
#: A token that groups of digits may follow, and one more group after what joins it to the last.
_GROUPS = re.compile(r"(?:[^\W\d_]+[:=.])?\+?\(?[0-9][0-9().-]*")
_MORE = {
    CARD: re.compile(r"(?:\x20|-)([0-9]++(?:-[0-9]++)*+)(?![\w@:/%])"),
    PHONE: re.compile(r"\)?(?:\x20-\x20|\x20\x20?|[.-])?\(?([0-9]++(?:[().-]{1,2}[0-9]++)*+)(?![\w@:/%])"),
}
#: Spark's condition for a token that is an identifier wherever it stands: five digits, or seven letters and digits.
TELLING = r"regexp_count(g.token, '[0-9]') >= 5 OR regexp_count(g.token, '[\\p{L}\\p{N}]') >= 7"
_DIGITS = str.maketrans("123456789", "0" * 9)

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    at, low = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                low = domain.end()
                yield start, low
        at = text.find("@", max(at + 1, low))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind and start."""
    return [(k, s, e) for k, find in enumerate(FINDERS.values()) for s, e in find(text)]


def context(text: str, start: int) -> str:
    """The two words before a position in its line, in lower case, digits as 0; what was long is cut to its end."""
    line = text[max(0, start - 200) : start].rpartition("\n")[2]
    return " ".join(line.lower().translate(_DIGITS).split()[-2:])


def grouped(text: str, start: int, end: int, kind: int, stop: int) -> Span:
    """The token from start to end with the groups of digits that follow it before ``stop``, as a number of the kind."""
    if kind == PHONE and text[start - 1 : start] == "(" and ")" in text[start : end + 1]:
        start -= 1
    if _GROUPS.fullmatch(text, start, end):
        digits = sum(map(str.isdigit, text[start:end])) if end - start <= 200 else 200
        while (m := _MORE[kind].match(text, end, min(stop, end + 50))) and not text[m.end() : m.end() + 1].isalnum():
            digits += sum(map(str.isdigit, m[1]))
            if digits > GROUPED[kind]:
                break
            end = m.end()
    return start, end


def contexts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, int, int]]:
    """(kind or -1, shape, context, token, start, end) of the seeds, and of other tokens with a digit or an at sign.

    Candidates stand once for each shape: 0 for a single token, and the kinds of GROUPED for a run of groups.
    """
    found = [(k, k if k in GROUPED else 0, context(text, s), text[s:e], s, e) for k, s, e in base]
    covered = sorted((s, e) for _, s, e in base)
    last, i, done = 0, 0, dict.fromkeys(GROUPED, 0)
    for m in re.finditer("[0-9@]", text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and text[start - 1] not in " \t\n\v\f\r":
            start -= 1
        last = _TOKEN.match(text, m.start()).end()
        token = text[start:last]
        cut = len(token) - len(token.lstrip(_EDGE))
        token = token.strip(_EDGE)
        s, e = start + cut, start + cut + len(token)
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if token and e - s <= 200 and not any(a < e and s < b for a, b in covered[i : i + 4]):
            found.append((-1, 0, context(text, s), token, s, e))
            for kind in GROUPED:
                if s >= done[kind]:
                    first, done[kind] = grouped(text, s, e, kind, covered[i][0] if i < len(covered) else len(text))
                    found.append((-1, kind, context(text, first), text[first : done[kind]], first, done[kind]))
    return [f for f in found if f[2]]


_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_GRAPH = "array<struct<kind:int,shape:int,context:string,token:string,start:bigint,end:bigint>>"


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, base, graph) of each row, written once."""

    def structs(rows: list[list[tuple]], names: list[str], types: list[pa.DataType]) -> pa.Array:
        kind = pa.struct(list(zip(names, types)))
        return pa.array([[dict(zip(names, r)) for r in own] for own in rows], pa.list_(kind))

    def work(batches: Batches) -> Batches:
        for batch in batches:
            base, graph = [], []
            for text in batch.column(3):
                text = text.as_py()
                base.append(base_spans(text))
                graph.append(contexts(text, base[-1]))
            yield record(
                row=batch.column(0),
                doc_id=batch.column(1),
                text_sha256=batch.column(2),
                base=structs(base, ["kind", "start", "end"], [pa.int32(), pa.int64(), pa.int64()]),
                graph=structs(graph, ["kind", "shape", "context", "token", "start", "end"], [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]),
            )

    text = text_of()
    prepared = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("sha"), text.alias("text"))
    return kept(map_batches(prepared, work, f"row bigint, doc_id bigint, text_sha256 string, base {_SPANS}, graph {_GRAPH}"), "spans")


def _shape() -> Column:
    """That of a kind's candidates."""
    return F.when(F.col("kind").isin(*GROUPED), F.col("kind")).otherwise(0)


def likely_tokens(candidates: DataFrame, confidence: DataFrame, support: int) -> DataFrame:
    """(token, kind, score, borne): logarithms are of one minus a likelihood, ``borne`` is that by contexts borne out alone."""
    doubt = F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))
    reached = candidates.join(confidence.withColumn("shape", _shape()), ["context", "shape"])
    return reached.groupBy("token", "kind").agg((1 - F.exp(F.sum(doubt))).alias("score"), F.sum(F.when(F.col("seeds") >= support, doubt).otherwise(0.0)).alias("borne"))


def good(found: DataFrame, rounds: int, least: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(context, kind, shape) and (token, kind, shape) that candidates are identifiers by, see above.

    A context bears a token out that it does not owe to itself, so that one seed's context can't bear itself out.
    """
    edges = found.select(F.explode("graph").alias("g")).groupBy("g.context", "g.token", "g.kind", "g.shape").agg(F.count(F.lit(1)).alias("n"))
    edges = kept(edges, "edges")
    shapes = F.explode(F.when(F.col("kind") >= 0, F.array(*map(F.lit, [0, *GROUPED]))).otherwise(F.array("shape")))
    totals = edges.select("context", shapes.alias("shape"), "n").groupBy("context", "shape").agg(F.sum("n").alias("total"))
    # contexts of seeds only: others never come to a confidence in the first round, and later only through tokens
    seeds = edges.where("kind >= 0").select("context", "kind", "token", "n", F.lit(1.0).alias("score"), F.lit(True).alias("bears"))
    candidates = edges.where("kind < 0").select("context", "shape", "token", "n")
    scores = seeds
    for _ in range(rounds):
        sums = scores.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("weight"), F.count_if("bears").alias("seeds"))
        confidence = kept(sums.withColumn("shape", _shape()).join(totals, ["context", "shape"]).select("context", "kind", "seeds", (F.col("weight") / (F.col("total") + 1)).alias("confidence")), "contexts")
        likely = kept(likely_tokens(candidates, confidence, support).where(F.col("score") >= least), "tokens")
        own = confidence.where(F.col("seeds") >= support).select("context", "kind", F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))).alias("own"))
        reached = candidates.join(likely.withColumn("shape", _shape()), ["token", "shape"]).join(own, ["context", "kind"], "left")
        bears = 1 - F.exp(F.col("borne") - F.coalesce("own", F.lit(0.0))) >= least
        scores = seeds.unionByName(reached.select("context", "kind", "token", "n", F.least(F.col("score"), F.lit(0.999)).alias("score"), bears.alias("bears")))
    best = confidence.where((F.col("confidence") >= least) & (F.col("seeds") >= support))
    best = best.groupBy("context", _shape().alias("shape")).agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("score"))
    sure = likely.where(1 - F.exp("borne") >= least)
    sure = sure.groupBy("token", _shape().alias("shape")).agg(F.max_by("kind", F.struct(-F.col("borne"), -F.col("kind"))).alias("kind"))
    return best, sure


def find(docs: DataFrame, rounds: int = 2, least: float = 0.6, support: int = 3) -> DataFrame:
    """doc_id, text_sha256, base, added (arrays of kind, start, end in code points) of every row of ``docs``.

    Null text is empty and has no spans.  Rows are searched each by itself, repeated ones too, but all count as evidence.
    No rows give no rows; other columns are ignored.  ``kind`` is the place in KINDS.  Of added spans within each other
    the longest stands; of equal ones that of the better context, and that of a context before that of a token.
    """
    found = scanned(docs)
    best, sure = good(found, rounds, least, support)
    free = found.select("row", F.explode("graph").alias("g")).where("g.kind < 0").select("row", "g.context", "g.shape", "g.token", "g.start", "g.end", F.expr(TELLING).alias("telling"))
    spans = free.join(best, ["context", "shape"]).select("row", "kind", "start", "end", "score")
    spans = spans.unionByName(free.where("telling").join(sure, ["token", "shape"]).select("row", "kind", "start", "end", F.lit(0.0).alias("score")))
    # of one text
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("score"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("end").over(before)).where("reached IS NULL OR end > reached")
    added = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return found.join(added, "row", "left").select("doc_id", "text_sha256", "base", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, by kind and start, with commas."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans (all of them), n_added."""
    counts = [F.size(F.array_compact(F.transform("base", lambda s: F.when(s["kind"] == k, 1)))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; overlapping spans go as the first."""
    spans = find(docs).where("size(base) + size(added) > 0").groupBy("text_sha256").agg(F.first(F.array_sort(F.concat("base", "added"))).alias("__spans"))
    named = docs.withColumn("__sha", F.sha2(text_of(), 256))
    both = named.join(spans.withColumnRenamed("text_sha256", "__sha").hint("merge"), "__sha", "left").drop("__sha")

    def work(batches: Batches) -> Batches:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if not s else replaced(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), batch.column("__spans").to_pylist())]
            yield batch.set_column(at, pa.field("text", pa.string()), pa.array(texts, pa.string())).drop_columns(["__spans"])

    return map_batches(both, work, docs.schema).select(docs.columns)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]
