"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. These are the seeds. Candidates are the other
identifier-like strings of a text: runs without white space of CANDIDATE_LENGTH or more characters with CANDIDATE_DIGITS digits; spaced
numbers (digits, spaces, brackets, stops and hyphens) of SPACED_DIGITS digits; and names of HANDLE_LENGTH or more characters without
enough digits that have an underscore, an @ or a capital after a small letter. Each
seed or candidate occurs in lexical patterns: the word before it, the word after it, both, and its own shape. Spark scores the graph of
patterns and instances in ROUNDS: a pattern's score is the smoothed mean score of its occurrences, where seeds count 1 and
unknown instances count what they scored so far (0 at first), and a pattern needs SUPPORT different instances of score THRESHOLD;
an instance scores as its best pattern. Instances of THRESHOLD or more are found, as kind `id`, wherever they occur as candidates.
Long instances, words and shapes are keyed by a digest of the whole, never by a prefix alone.

Patterns of many instances are joined in SALTS parts, and what is summed by pattern or instance is summed in part before it is shuffled.

Defined cases: null text is empty; an empty table gives no row; repeated rows are rows of their own, and count in the
graph once a row; a null doc_id is kept; very long texts are scanned in linear time (no pattern rescans a run, and the text
between two spans is looked at once for each of them); extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, materialize, small_batches, table

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
CANDIDATE_LENGTH, CANDIDATE_DIGITS = 10, 4
SPACED_DIGITS, HANDLE_LENGTH = 7, 8
ROUNDS, THRESHOLD, SUPPORT, SMOOTHING = 3, 0.6, 3, 1.0
#: Parts that a pattern's instances are dealt to, and characters from which on a string is keyed by a digest.
SALTS, LONG = 16, 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_SPACED = re.compile(r"[0-9(][\x20().0-9-]*+")
_HANDLE = re.compile(r"[A-Za-z0-9_.@-]++")
_MIXED = re.compile(r"[_@]|[a-z][A-Z]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches: the local part reaches back from each @ to the end of the last match at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def addresses(text: str) -> Iterator[Span]:
    """Four parts in a row of each run of digits and dots, left to right; a run is split once."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        i, begin = 0, run.start()
        while i + 3 < len(parts):
            if not all(four := parts[i : i + 4]):
                begin += len(parts[i]) + 1
                i += 1
                continue
            end = begin + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in four):
                yield begin, end
            begin, i = end + 1, i + 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := "".join(_DIGIT.findall(m[0]))) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


def instance(text: str) -> str:
    """The key of a string: itself, or a prefix and the digest of the whole where it is long."""
    return text if len(text) <= LONG else f"{text[:LONG]} {hashlib.md5(text.encode()).hexdigest()}"


def shape(text: str) -> str:
    """Letters a and A, digits 9, runs shortened."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", text)), flags=re.DOTALL)


def _runs(text: str) -> Iterator[Span]:
    """Runs without white space that have digits."""
    end = 0
    for d in _DIGIT.finditer(text):
        if d.start() < end:
            continue
        begin = d.start()
        while begin > end and not text[begin - 1].isspace():
            begin -= 1
        end = _WORD.match(text, begin).end()
        run = text[begin:end]
        first = begin + len(run) - len(run.lstrip("\"'([{<.,;:!?"))
        last = end - (len(run) - len(run.rstrip("\"')]}>.,;:!?")))
        if last - first >= CANDIDATE_LENGTH and len(_DIGIT.findall(text, first, last)) >= CANDIDATE_DIGITS:
            yield first, last


def _spaced(text: str) -> Iterator[Span]:
    for m in _SPACED.finditer(text):
        run = m[0].rstrip(" .-(")
        if " " in run and len(_DIGIT.findall(run)) >= SPACED_DIGITS:
            yield m.start(), m.start() + len(run)


def _handles(text: str) -> Iterator[Span]:
    for m in _HANDLE.finditer(text):
        run = m[0].strip(".-")
        if len(run) >= HANDLE_LENGTH and len(_DIGIT.findall(run)) < CANDIDATE_DIGITS and _MIXED.search(run):
            first = m.start() + len(m[0]) - len(m[0].lstrip(".-"))
            yield first, first + len(run)


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Identifier-like strings outside of taken spans, which are in order, and of each other: the first, then the longest."""
    out: list[Span] = []
    k, end = 0, 0
    for first, last in sorted({*_runs(text), *_spaced(text), *_handles(text)}, key=lambda s: (s[0], -s[1])):
        if first < end:
            continue
        while k < len(taken) and taken[k][1] <= first:
            k += 1
        if k == len(taken) or taken[k][0] >= last:
            out.append((first, last))
            end = last
    return out


def contexts(text: str, spans: list[Span]) -> list[list[str]]:
    """The lexical patterns of each span, in order of the spans. A neighbour word lies between a span and the one before or after it."""
    out = []
    order = sorted(range(len(spans)), key=lambda i: spans[i])
    edge = 0
    before: dict[int, str] = {}
    for i in order:
        begin, end = spans[i]
        near = text[min(edge, begin) : begin].rsplit(None, 1)
        before[i] = near[-1].lower() if near else "^"
        edge = max(edge, end)
    for place, i in enumerate(order):
        after = _WORD.search(text, spans[i][1], max(spans[i][1], spans[order[place + 1]][0] if place + 1 < len(order) else len(text)))
        left, right = instance(before[i]), instance(after[0].lower() if after else "$")
        out.append((i, [f"l:{left}", f"r:{right}", f"lr:{left} {right}", f"s:{instance(shape(text[slice(*spans[i])]))}"]))
    return [patterns for _, patterns in sorted(out)]


SCANNED = "doc_id long, digest string, base array<array<string>>, n array<long>, seen array<struct<instance:string,seed:boolean,begin:int,end:int,patterns:array<string>>>"


def scan(documents: DataFrame) -> DataFrame:
    """Per document: digest of the text, base spans by kind, and the seeds and candidates with their patterns. Text is read once."""
    small_batches(documents.sparkSession)
    schema = arrow_schema(documents.sparkSession, SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = base_spans(text)
                taken = sorted(s for x in spans.values() for s in x)
                found = [*taken, *candidates(text, taken)]
                seen = [{"instance": instance(text[b:e]), "seed": i < len(taken), "begin": b, "end": e, "patterns": patterns} for i, ((b, e), patterns) in enumerate(zip(found, contexts(text, found), strict=True))]
                out.append({"doc_id": doc_id, "digest": hashlib.md5(text.encode()).hexdigest(), "base": [[f"{k}:{b}:{e}" for b, e in spans[k]] for k in KINDS], "n": [len(spans[k]) for k in KINDS], "seen": seen})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCANNED)


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The instances found: one row each, with their score. Edges are counted before any join, and each round is written."""
    seen = scanned.select(F.explode("seen").alias("x")).select("x.*")
    edges = seen.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = materialize(edges, "edges")
    instances = edges.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        scored = edges.join(instances.select("instance", "score"), "instance")
        mean = F.sum(F.col("n") * F.col("score")) / (F.sum("n") + SMOOTHING)
        patterns = scored.groupBy("pattern").agg(mean.alias("p"), F.count_if(F.col("score") >= threshold).alias("support")).where(F.col("support") >= support)
        patterns = patterns.select("pattern", "p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        best = edges.withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int")).join(patterns, ["pattern", "salt"]).groupBy("instance").agg(F.max("p").alias("best"))
        instances = instances.drop("score").join(best, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
        instances = materialize(instances, "instances")
    return instances.where(~F.col("seed") & (F.col("score") >= threshold)).select("instance", "score")


def _listed(spans: Column) -> Column:
    return F.array_join(F.flatten(spans), ",")


def found_spans(scanned: DataFrame, instances: DataFrame) -> DataFrame:
    """__doc, __digest, __more: the spans of found instances by text, for texts that have any."""
    seen = scanned.select("doc_id", "digest", F.explode("seen").alias("x")).where(~F.col("x.seed")).select("doc_id", "digest", "x.instance", "x.begin", "x.end").distinct()
    met = seen.join(instances.select("instance"), "instance")
    by = met.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("more"))
    return by.withColumnsRenamed({"doc_id": "__doc", "digest": "__digest", "more": "__more"})


def find(documents: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """What scan gives (written), and the found spans of texts that have any."""
    scanned = materialize(scan(documents), "scanned")
    return scanned, found_spans(scanned, bootstrap(scanned, rounds, threshold, support))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and n_chars, if there, counted anew. All columns stay.
    Spans that overlap are replaced as one, by the kind of the first."""
    _, more = find(documents)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = documents.join(more, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.md5(text) == F.col("__digest")), "left").select(*documents.columns, "__more")
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            columns = dict(zip(names, batch.columns, strict=False))
            out = [None if t is None else masked(t, [(x["begin"], x["end"]) for x in m or []]) for t, m in zip(batch.column("text").to_pylist(), batch.column("__more").to_pylist(), strict=True)]
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t or "") for t in out], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return met.mapInArrow(run, documents.schema)


def masked(text: str, more: list[Span]) -> str:
    spans = sorted([(b, e, kind) for kind, found in base_spans(text).items() for b, e in found] + [(b, e, FOUND) for b, e in more])
    out, at, till = [], 0, 0
    for begin, end, kind in spans:
        if begin >= till:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = till = max(till, end)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, more = find(table(spark, sf_dir, "documents"))
    met = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("digest") == F.col("__digest")), "left")
    own = F.transform(F.coalesce(F.col("__more"), F.array().cast("array<struct<begin:int,end:int>>")), lambda x: F.concat_ws(":", F.lit(FOUND), x["begin"], x["end"]))
    counts = [F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return met.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), F.array_join(F.concat(F.flatten("base"), own), ",").alias("spans"), F.size(own).cast("long").alias("n_found"))
