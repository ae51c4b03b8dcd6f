"""Prompts as columns: a template is compiled once into one expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt template ids by kind of dataset, for checking subsets and for scoring directly. Kinds without an id have no context.
VERIFY = {"ssv2": "mss_verification_ssv2", "k400": "mss_verification_k400"}
DIRECT = {"ssv2": "direct_scoring_ssv2", "k400": "direct_scoring_k400", "diving48": "direct_scoring_diving48", "generic": "direct_scoring"}

_NAME = re.compile(r"\{([A-Za-z_][A-Za-z_0-9]*)\}")


def template_names(template: str) -> list[str]:
    """The names in braces, in order of their first appearance; doubled braces are braces."""
    return list(dict.fromkeys(_NAME.findall(template.replace("{{", "").replace("}}", ""))))


def render(template: str, values: Column) -> Column:
    """text and `missing` of a template: each name in braces is replaced by the map's value, or kept as it is and listed where the map has
    none. Values aren't read as templates."""
    parts, at = [], 0
    marked = template.replace("{{", "\x00").replace("}}", "\x01")
    plain = lambda x: F.lit(x.replace("\x00", "{").replace("\x01", "}"))
    for m in _NAME.finditer(marked):
        parts += [plain(marked[at : m.start()]), F.coalesce(F.try_element_at(values, F.lit(m[1])), F.lit(m[0]))]
        at = m.end()
    names = F.array(*map(F.lit, template_names(template))).cast("array<string>")
    missing = F.filter(names, lambda n: F.try_element_at(values, n).isNull())
    return F.struct(F.concat(*parts, plain(marked[at:])).alias("text"), missing.alias("missing"))


def placeholder_text(raw: Column) -> Column:
    """Names from a JSON list, comma-separated; any other text as it is; unknown where there is none."""
    listed = F.try_variant_get(F.try_parse_json(raw), "$", "array<string>")
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(F.coalesce(F.array_join(listed, ", "), raw))


def context(kind: Column, label: Column, placeholders: Column, found: Column, direct: bool = False) -> Column:
    """The map of names for a record's prompt, with its prompt_template_id; null where the kind has no template of its own. found is a struct of the placeholders and label that
    another table has for the record, used where the record has no placeholders."""
    ids = DIRECT if direct else VERIFY
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    name = F.lower(F.trim(kind))
    name = F.when(name.isin("ssv2", "k400", "diving48"), name).otherwise("generic")
    bare = F.coalesce(placeholders, F.lit("")) == ""
    action = F.when(bare & found["label"].isNotNull(), found["label"]).otherwise(label)
    objects = placeholder_text(F.when(bare, found["placeholders"]).otherwise(placeholders))
    id_ = F.try_element_at(known, name)
    ssv2 = F.create_map(F.lit("action_template"), action, F.lit("placeholders"), objects, F.lit("prompt_template_id"), id_)
    others = F.create_map(F.lit("action_label"), label, F.lit("prompt_template_id"), id_)
    return F.when(id_.isNotNull(), F.when(name == "ssv2", ssv2).otherwise(others))
