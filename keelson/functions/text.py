"""Scalar functions on text: keys, paths, condition grammar, truncated JSON, answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The signs around a label, and at its end, that don't count.
OPENING, CLOSING, STOPS = "[(\"'", "])\"'", ".,;!?'\"`"


def label_key(label: Column) -> Column:
    """Normal form of a label: brackets and quotes around it go, then stops and quotes at its end, lower case, single spaces."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    inner = F.rtrim(F.ltrim(strip(label), F.lit(OPENING)), F.lit(CLOSING))
    return F.regexp_replace(F.lower(strip(F.rtrim(strip(inner), F.lit(STOPS)))), r"\s+", " ")


# The keys under which answers list their labels.
ANSWER_KEYS = ("top5_label_ids", "top5_ids", "top5")


def _variants(text: Column, bare: bool) -> Column:
    """The answer list of a JSON text as an array of variants: of an object by its key, or (bare) the list itself."""
    found = F.try_parse_json(text)
    paths = [*(f"$.{k}" for k in ANSWER_KEYS), *(["$"] if bare else [])]
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(found, p, "variant")).startswith("ARRAY"), F.try_variant_get(found, p, "array<variant>")) for p in paths])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _first_list(text: Column) -> Column:
    """From the last opening bracket before the first closing one that follows an opening one, up to that; null without such."""
    rest = F.substring(text, F.locate("[", text), F.length(text))
    inner = F.substring_index(F.substring_index(rest, "]", 1), "[", -1)
    return F.when((F.locate("[", text) > 0) & (F.locate("]", rest) > 0), F.concat(F.lit("["), inner, F.lit("]")))


def _first_object(text: Column) -> Column:
    """From the first opening brace to the next closing one."""
    rest = F.substring(text, F.locate("{", text), F.length(text))
    return F.when((F.locate("{", text) > 0) & (F.locate("}", rest) > 0), F.concat(F.substring_index(rest, "}", 1), F.lit("}")))


def _unfenced(text: Column) -> Column:
    """A text that is a fence as a whole, without it: the fence's first word and its end go."""
    inner = F.regexp_replace(F.ltrim(text, F.lit("`")), r"^\w*", "")
    return F.when(text.startswith("```"), F.trim(F.rtrim(F.regexp_replace(inner, r"\s+$", ""), F.lit("`")))).otherwise(text)


#: Why five_answers gives none.
NO_LIST, NOT_FIVE, ID_RANGE, SAME_IDS, MIXED, UNKNOWN_LABEL, SAME_LABELS = "no list", "not five: ", "id range", "same ids", "mixed kinds", "unknown label", "same labels"


def five_answers(raw: Column, labels: list[str]) -> Column:
    """(labels, normalized, reason) of a model's answer: five different ids (from 0) or labels of a taxonomy, in an object or a bare list,
    alone, in a fence or among other text. A reason says why there are none, else it is empty."""
    names, keys = F.array(*map(F.lit, labels)), F.array(*[label_key(F.lit(x)) for x in labels])
    nothing = F.array().cast("array<string>")

    def found(body: Column) -> Column:
        return F.coalesce(_variants(body, True), _variants(_first_object(body), False), F.try_variant_get(F.try_parse_json(_first_list(body)), "$", "array<variant>"))

    def item(v: Column) -> Column:
        kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        number = F.when((kind == "BIGINT") | (kind == "STRING"), F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("int"))
        whole = F.when(F.regexp_replace(text, r"^\s+|\s+$", "").rlike(r"^-?\d+$"), number)
        place = F.nullif(F.array_position(keys, label_key(text)), F.lit(0)).cast("int")
        label = F.when(kind == "STRING", F.when(F.array_contains(names, text), text).otherwise(F.try_element_at(names, place)))
        return F.struct(kind.alias("kind"), text.alias("text"), whole.alias("id"), label.alias("label"))

    def judged(items: Column) -> Column:
        numeric = F.forall(items, lambda x: x["id"].isNotNull())
        fewer = lambda part: F.size(F.array_distinct(F.transform(items, lambda x: x[part]))) < 5
        reason = F.when(items.isNull(), NO_LIST).when(F.size(items) != 5, F.concat(F.lit(NOT_FIVE), F.size(items).cast("string")))
        reason = reason.when(numeric & F.exists(items, lambda x: (x["id"] < 0) | (x["id"] >= len(labels))), ID_RANGE).when(numeric & fewer("id"), SAME_IDS)
        reason = reason.when(numeric, "").when(F.exists(items, lambda x: x["kind"] != "STRING"), MIXED)
        reason = reason.when(F.exists(items, lambda x: x["label"].isNull()), UNKNOWN_LABEL).when(fewer("label"), SAME_LABELS).otherwise("")
        chosen = F.transform(items, lambda x: F.when(numeric, F.get(names, x["id"])).otherwise(x["label"]))
        changed = ~numeric & F.exists(items, lambda x: x["text"] != x["label"])
        return let(reason, lambda r: F.struct(F.when(r == "", chosen).otherwise(nothing).alias("labels"), ((r == "") & F.coalesce(changed, F.lit(False))).alias("normalized"), r.alias("reason")))

    body = _unfenced(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return let(let(body, lambda b: F.transform(found(b), item)), judged)


def field_after(raw: Column, name: str) -> Column:
    """The JSON literal (text or number) that follows the first quoted name, whatever its case, and a colon; null if none does. Texts come without their quotes,
    with their escapes."""
    literal = r"""^\s*:\s*("(?:\\.|[^\\"])*"|[-+]?[0-9.][0-9.eE+-]*)"""
    after = let(F.locate(f'"{name}"', F.lower(raw)), lambda place: F.when(place > 0, F.regexp_extract(F.substring(raw, place + len(name) + 2, F.length(raw)), literal, 1)))
    return let(after, lambda value: F.when(value != "", F.when(value.startswith('"'), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)))


def last_resort(raw: Column) -> Column:
    """decision, confidence and evidence sought in a text that can't be parsed; null without a decision. A summary of the action is evidence too."""
    said = let(F.coalesce(field_after(raw, "action_summary"), field_after(raw, "evidence")), lambda s: F.when(s != "", s))
    return let(field_after(raw, "decision"), lambda choice: F.when(choice != "", F.struct(choice.alias("decision"), field_after(raw, "confidence").try_cast("double").alias("confidence"), said.alias("evidence"))))


def bracketless(label: Column) -> Column:
    return F.lower(F.translate(label, "[]", ""))


def stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def record_key(name: Column) -> tuple[Column, Column]:
    """(video_id, condition) of a name, split at the last double underscore; without one the condition is full."""
    has = F.instr(name, "__") > 0
    condition = F.when(has, F.substring_index(name, "__", -1)).otherwise("full")
    return F.when(has, F.substring(name, F.lit(1), F.length(name) - F.length(condition) - 2)).otherwise(name), condition


def scrub_path(path: Column, root: str = "data/") -> Column:
    """What follows the last directory of that name."""
    return F.regexp_replace(path, "^.*/" + root, "")


def parse_condition(condition: Column) -> Column:
    """family and percent of names like score-threshold-t40, fastforward-a25, id-vlm-f50; both null for others."""
    pattern = r"^(.*-threshold-t|.*fastforward-a|id-[a-z-]+-f)(\d{1,3})$"
    family = F.nullif(F.regexp_replace(F.regexp_extract(condition, pattern, 1), "-[taf]$", ""), F.lit(""))
    return F.struct(family.alias("family"), F.nullif(F.regexp_extract(condition, pattern, 2), F.lit("")).cast("int").alias("percent"))


def run_hash(path: str, digest: str) -> Column:
    """Aggregate: one digest of a set of files, whatever their order."""
    lines = F.array_sort(F.collect_list(F.concat(F.col(path), F.lit("\x01"), F.col(digest), F.lit("\x01"))))
    return F.sha2(F.array_join(lines, ""), 256)


# How answers mark thoughts and fenced text, and the keys that an oracle's answer has at least one of.
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
_THINK = re.compile(r"<think>.*?</think>", re.DOTALL)
ORACLE_KEYS = ("decision", "confidence", "action_summary", "evidence", "segments", "minimum_sufficient_set")


def repair(text: str | None, keys: tuple[str, ...] = ()) -> tuple[str | None, str]:
    """(JSON text, how): strict, fenced, balanced (the first braces that parse), closed (cut short, then closed), or none. Where keys are
    given, only an object that has one of them counts."""
    body = _THINK.sub("", text or "")
    wanted = set(keys)
    fits = lambda x: isinstance(x, dict) and (not wanted or not wanted.isdisjoint(x))
    for how, pieces in (("strict", [body]), ("fenced", _FENCE.findall(body))):
        for piece in pieces:
            try:
                found = json.loads(piece)
            except (ValueError, RecursionError):
                continue
            if fits(found):
                return json.dumps(found), how
    if (found := _object_in(body, fits)) is not None:
        return json.dumps(found), "balanced"
    at = body.find("{")
    if at >= 0 and (closed := _close(body[at:])) and fits(json.loads(closed)):
        return closed, "closed"
    return None, "none"


def _object_in(text: str, fits: Callable[[object], bool]) -> dict | None:
    """The first object in a text that fits, in order of their opening braces, nested ones too. What a failed attempt has read isn't read again: braces
    that are open where it failed would fail there as well."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
        except RecursionError:
            at = _less_deep(text, at)
            continue
        except json.JSONDecodeError as error:
            still_open = set(_open_braces(text, at, error.pos))
            if (inner := _complete(decoder, text, at + 1, error.pos, still_open, fits)) is not None:
                return inner
            at = text.find("{", max(error.pos, at + 1))
            continue
        if (inner := _fitting(found, fits)) is not None:
            return inner
        at = text.find("{", end)
    return None


#: Objects within objects that the parser reads for sure.
_DEPTH = 500


def _less_deep(text: str, at: int) -> int:
    """The next brace after one whose object is too deep to be parsed: those that hold more than _DEPTH levels at the deepest place are passed over."""
    depth, most, place = 0, 0, at
    quoted = escaped = False
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
            if depth > most:
                most, place = depth, i
        elif c == "}":
            depth -= 1
    opens = _open_braces(text, at, place + 1)
    return opens[-_DEPTH] if len(opens) > _DEPTH else text.find("{", at + 1)


def _complete(decoder: json.JSONDecoder, text: str, at: int, until: int, still_open: set[int], fits: Callable[[object], bool]) -> dict | None:
    """The first fitting object among those that open from `at` on and are complete before `until`."""
    at = text.find("{", at, until)
    while at >= 0:
        if at not in still_open:
            try:
                found, at = decoder.raw_decode(text, at)
            except (json.JSONDecodeError, RecursionError):  # a brace in a text
                at += 1
            else:
                if (inner := _fitting(found, fits)) is not None:
                    return inner
        else:
            at += 1
        at = text.find("{", at, until)
    return None


def _open_braces(text: str, start: int, end: int) -> list[int]:
    """Braces that open from start on and are open at end, strings respected."""
    opens, quoted, escaped = [], False, False
    for i in range(start, end):
        c = text[i]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c == "{":
            opens.append(i)
        elif c == "}" and opens:
            opens.pop()
    return opens


def _fitting(value: object, fits: Callable[[object], bool]) -> dict | None:
    """The first object that fits in a parsed value, outer ones first."""
    left = [value]
    while left:
        v = left.pop()
        if fits(v):
            return v
        left += reversed(list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else [])
    return None


def _close(text: str) -> str | None:
    """Closes a cut object, dropping trailing members until it parses."""
    cuts, stack, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if c == ",":
            cuts.append((i, quoted, "".join(reversed(stack))))
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    for cut, quoted, closers in [(len(text), quoted, "".join(reversed(stack))), *reversed(cuts)]:
        piece = text[:cut].rstrip().rstrip(",")
        try:
            found = json.loads(piece + '"' * quoted + closers)
        except ValueError:
            continue
        return json.dumps(found)
    return None


def repaired(text: Column, keys: tuple[str, ...] = ()) -> Column:
    """Column form of repair: json and recovery."""

    @F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("recovery", T.StringType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t, keys) for t in texts], columns=["json", "recovery"])

    return run(text)


def confidence(value: Column) -> Column:
    """In [0, 1], one half if missing."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), F.lit(0.5))


def decision(word: Column) -> Column:
    """YES, NO or SKIP; other words for not knowing are SKIP."""
    w = F.upper(F.trim(word))
    return F.when(w.isin("YES", "NO"), w).when(w.isin("SKIP", "INSUFFICIENT", "UNKNOWN", "UNCERTAIN"), "SKIP")


def fill_gaps(given: Column, nothing: float = 0.5) -> Column:
    """Missing scores of an array are the mean of the neighbours; a filled score is the next one's left neighbour. Ends take the
    neighbour they have, and `nothing` where no score is known."""

    def right(scores: Column, i: Column) -> Column:
        return F.try_element_at(F.filter(F.slice(scores, i + 1, F.size(scores)), lambda x: x.isNotNull()), F.lit(1))

    def step(scores: Column, a: Column, i: Column) -> Column:
        own, left = F.get(scores, i - 1), F.try_element_at(a, F.lit(-1))
        filled = F.coalesce(own, (left + right(scores, i)) / 2, left, right(scores, i), F.lit(nothing))
        return F.concat(a, F.array(filled))

    return let(given, lambda scores: F.aggregate(F.sequence(F.lit(1), F.size(scores)), F.array().cast("array<double>"), lambda a, i: step(scores, a, i)))


#: Veltkamp's factor, which cuts a double in two halves whose products are exact.
_CUT = 134217729.0


def _off(a: Column, b: Column, product: Column) -> Column:
    """What the product of two doubles lacks of the exact one (Dekker)."""
    high = lambda x: x * _CUT - (x * _CUT - x)
    ah, bh = high(a), high(b)
    return ((ah * bh - product) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)


def _six(size: Column, power: Column, up: bool) -> Column:
    """size * power, or size / power, as a whole number; the exact value is rounded, half to even."""

    def rounded(whole: Column, side: Column) -> Column:
        return whole.cast("long") + F.when((side > 0) | (side == 0) & (whole % 2 == 1), 1).otherwise(0)

    if up:
        return let(size * power, lambda p: let(F.floor(p).cast("double"), lambda n: let(p - n - 0.5, lambda d: rounded(n, F.when(d != 0, d).otherwise(_off(size, power, p))))))
    return let(F.floor(size / power).cast("double"), lambda n: let((n + 0.5) * power, lambda t: rounded(n, F.when(size != t, size - t).otherwise(-_off(n + 0.5, power, t)))))


def general(x: Column) -> Column:
    """A number as C's %g: six significant digits of its exact value, half to even, no trailing zeros, with an exponent below 1e-4 and from 1e6 on. Zero has no sign. From 1e28
    on and below 1e-17 the digits are rounded from the shortest text of the number."""
    size, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    plain = lambda number: F.rtrim(F.rtrim(number.cast("decimal(20,9)").cast("string"), F.lit("0")), F.lit("."))
    scale = F.lit(1e9)
    for e in range(-3, 6):
        scale = F.when(size >= 10.0**e, 10.0 ** (5 - e)).otherwise(scale)
    fixed = F.concat(sign, plain(let(scale, lambda c: _six(size, c, True) / c)))

    def exponent(e: Column) -> Column:
        return e + F.when(size >= F.pow(F.lit(10.0), e + 1), 1).when(size < F.pow(F.lit(10.0), e), -1).otherwise(0)

    def powered(e: Column) -> Column:
        digits = F.when(e > 5, _six(size, F.pow(F.lit(10.0), e - 5), False)).otherwise(_six(size, F.pow(F.lit(10.0), 5 - e), True))
        return let(digits, lambda d: let(F.when(d > 999_999, e + 1).otherwise(e), lambda at: F.when(at == -4, "0.0001").otherwise(
            F.concat(plain(d / F.when(d > 999_999, 1_000_000).otherwise(100_000)), F.when(at < 0, "e-").otherwise("e+"), F.lpad(F.abs(at).cast("string"), 2, "0")))))

    shortest = F.regexp_replace(F.format_string("%.5e", size), r"\.?0+(e)", "$1")
    power = F.when(F.isnan(x), "nan").when(size == float("inf"), "inf").when((size >= 1e28) | (size < 1e-17), shortest).otherwise(let(let(F.floor(F.log10(size)).cast("int"), exponent), powered))
    whole = (size < 1e6) & (F.floor(x) == x)
    return F.when(x.isNull(), None).when(whole, x.cast("long").cast("string")).when((size >= 1e-4) & (size < 999999.5), fixed).otherwise(F.concat(sign, power))


def time_range(start: Column, end: Column) -> Column:
    """Null if either end is."""
    return F.concat(general(start), F.lit("-"), general(end))


def first_containing(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (part, name) whose part the text contains, whatever its case."""
    lower, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for part, name in reversed(rules):
        out = F.when(lower.contains(part), name).otherwise(out)
    return out


def first_prefix(text: Column, rules: list[tuple[str, str]], default: str, explicit: Column | None = None) -> Column:
    """An explicit name unless it is empty or auto, else the name of the first rule (prefix, name) that the text starts with."""
    out = F.lit(default)
    for prefix, name in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).startswith(prefix), name).otherwise(out)
    return out if explicit is None else F.when(~F.coalesce(explicit, F.lit("")).isin("", "auto"), explicit).otherwise(out)


def class_name(kind: Column, sources: dict[str, list[Column]]) -> Column:
    """By kind of dataset, the first source of a name that isn't empty; null for other kinds."""
    out = F.lit(None).cast("string")
    for name, columns in sources.items():
        out = F.when(kind == name, F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])).otherwise(out)
    return out


def other_columns(df: DataFrame, keys: list[str]) -> Column:
    """All columns but the keys as one map of texts; NaN is null."""
    value = lambda c, kind: (F.when(~F.isnan(c), F.col(c)) if kind in ("double", "float") else F.col(c)).cast("string")
    return F.create_map(*[x for c, kind in df.dtypes if c not in keys for x in (F.lit(c), value(c, kind))])


def settings(given: dict, config: dict, defaults: dict) -> dict:
    """Options of a run: what was given (not None), else what the config's sections or top level say, else the default. Unknown names are left out."""
    flat = {k: v for x in (config, *(v for v in config.values() if isinstance(v, dict))) for k, v in x.items() if not isinstance(v, dict)}
    return {name: given[name] if given.get(name) is not None else flat.get(name, default) for name, default in defaults.items()}


def scrub_json(document: Column, root: str) -> Column:
    """A JSON text in which string values lose a leading root, at any depth; keys stay."""
    return F.regexp_replace(document, r'([\[,:{]\s*")' + re.escape(root) + r'(?=(?:[^"\\]|\\.)*"\s*[,\]}])', "$1")


def direct_scores(raw: Column, n: Column) -> Column:
    """weights and kept of an answer that scores n segments itself: importances in percent by segment ids from 1 (the last of equal ids counts, gaps are filled), and its minimal set, or the
    segments of one half and more where it names none. Null if there is no such object, no list of segments, or nothing is kept."""
    after = F.when(F.contains(raw, F.lit("</think>")), F.substring(raw, F.locate("</think>", raw) + 8, F.length(raw))).otherwise(raw)
    parsed = F.try_parse_json(repaired(after, ("segments",))["json"])
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def read(v: Column) -> Column:
        said = F.try_variant_get(v, "$.segments", "array<variant>")
        items = F.transform(said, lambda x: F.struct(F.try_variant_get(x, "$.segment_id", "int").alias("id"), F.coalesce(F.try_variant_get(x, "$.importance", "double"), F.lit(0.0)).alias("importance")))
        own = let(items, lambda items: F.transform(places, lambda i: F.try_element_at(F.filter(items, lambda x: x["id"] == i + 1), F.lit(-1))["importance"] / 100))
        named = F.coalesce(F.try_variant_get(v, "$.minimum_sufficient_set", "array<int>"), F.array().cast("array<int>"))
        inside = F.array_sort(F.array_distinct(F.filter(F.transform(named, lambda i: i - 1), lambda i: (i >= 0) & (i < n))))

        def chosen(weights: Column) -> Column:
            least = F.filter(places, lambda i: F.get(weights, i) >= 0.5)
            return let(F.when(F.size(named) > 0, inside).otherwise(least), lambda kept: F.when(F.size(kept) > 0, F.struct(weights.alias("weights"), kept.alias("kept"))))

        return F.when((F.size(said) > 0) & (n > 0), let(fill_gaps(own, 0.0), chosen))

    return let(parsed, read)


def now_iso() -> Column:
    """The time of the query as ISO-8601 text, in microseconds of the session's time zone."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def forbidden(text: Column, markers: list[str]) -> Column:
    """The markers that a text still contains."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))
