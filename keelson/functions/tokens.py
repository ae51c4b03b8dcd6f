"""What a model's tokens say about its decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.text import let

# The decisions, the end of a thought, and the confidences at which a text contradicts its tokens.
DECISIONS, THOUGHT_END = ("YES", "NO", "SKIP"), "</think>"
SURELY, HARDLY = 0.99, 0.01
#: Tokens are structs of token, logprob and `top`, an array of the likeliest tokens there with their logprobs.
TOKENS = "array<struct<token:string,logprob:double,top:array<struct<token:string,logprob:double>>>>"


def _word(token: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(token, F.lit("")), r"^\s+|\s+$", ""))


def decision_logprobs(tokens: Column, own: str = "missing") -> Column:
    """position, yes, no, skip: logprobs at the first decision token after a thought, if there is one. Of several variants of a word among the likeliest
    tokens the greatest counts; the token itself counts where its word is missing among them, or (own="greatest") like any variant.
    position is -1 where no token decides, and -2 where nothing follows the thought."""

    def at(entry: Column) -> Column:
        """The words' greatest logprobs at one token."""
        word = _word(entry["token"])

        def best(name: str) -> Column:
            variants = F.array_max(F.transform(F.filter(F.coalesce(entry["top"], F.array()), lambda t: _word(t["token"]) == name), lambda t: t["logprob"]))
            mine = F.when(word == name, entry["logprob"])
            return F.greatest(variants, mine) if own == "greatest" else F.coalesce(variants, mine)

        return F.struct(*[best(name).alias(name.lower()) for name in DECISIONS])

    def read(start: Column) -> Column:
        numbered = F.transform(F.slice(tokens, start + 1, F.size(tokens)), lambda t, i: F.struct((i + start).alias("position"), at(t).alias("found"), _word(t["token"]).isin(*DECISIONS).alias("decides")))
        first = F.try_element_at(F.filter(numbered, lambda x: x["decides"] & F.coalesce(*[x["found"][n.lower()] for n in DECISIONS]).isNotNull()), F.lit(1))
        none = F.when((start > 0) & (start >= F.size(tokens)), -2).otherwise(-1)
        return let(first, lambda x: F.struct(F.coalesce(x["position"], none).alias("position"), *[x["found"][n.lower()].alias(n.lower()) for n in DECISIONS]))

    ends = F.transform(tokens, lambda t: F.coalesce(F.contains(t["token"], F.lit(THOUGHT_END)), F.lit(False)))
    return F.when(tokens.isNotNull(), let(F.coalesce(F.array_position(ends, F.lit(True)), F.lit(0)).cast("int"), read))


def yes_and_skip(yes: Column, no: Column, skip: Column) -> Column:
    """p_yes among YES and NO alone, and p_skip among all three (null without skip)."""
    gap = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), yes - no))
    most = F.greatest(yes, no, skip)
    total = F.exp(yes - most) + F.exp(no - most) + F.exp(skip - most)
    return F.struct((1 / (1 + F.exp(-gap))).alias("p_yes"), (F.exp(skip - most) / total).alias("p_skip"))


def token_confidence(decision: Column, confidence: Column, tokens: Column, own: str = "missing") -> Column:
    """logit_confidence, logit_p_skip and `source` of an answer: tokens, or why the text decides instead (no_tokens, thought_only, no_decision, partial,
    anomaly). A text's confidence counts for YES; for NO it is 0, and for anything else 0 with a p_skip of 1."""

    def judged(found: Column) -> Column:
        both = yes_and_skip(found["yes"], found["no"], found["skip"])
        why = F.when(F.coalesce(F.size(tokens), F.lit(0)) < 1, "no_tokens").when(found["position"] == -2, "thought_only").when(found["position"] == -1, "no_decision")
        why = why.when(found["yes"].isNull() | found["no"].isNull(), "partial")
        against = F.coalesce((decision == "YES") & (both["p_yes"] < HARDLY) | (decision == "NO") & (both["p_yes"] > SURELY), F.lit(False))
        source = why.when(against, "anomaly").otherwise("tokens")
        stated = F.when(decision == "YES", confidence).otherwise(0.0)
        unsure = F.when(~F.coalesce(decision.isin("YES", "NO"), F.lit(False)), 1.0)
        return let(source, lambda s: F.struct(F.when(s == "tokens", both["p_yes"]).otherwise(stated).alias("logit_confidence"), F.when(s == "tokens", both["p_skip"]).otherwise(unsure).alias("logit_p_skip"), s.alias("source")))

    return let(decision_logprobs(tokens, own), judged)
