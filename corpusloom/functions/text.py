"""Column functions over texts and conversations; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker strings and the size of the reserved block.
EOT, IM_START, IM_END = "<|endoftext|>", "<|im_start|>", "<|im_end|>"
N_RESERVED = 32
SEP = "\n<|endoftext|>\n"
SPECIAL = r"<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<\|reserved_(?:1?[0-9]|2[0-8])\|>"
#: White space as Python sees it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def special_block(n: int = N_RESERVED) -> list[str]:
    """The special strings in id order: three named ones, the rest reserved."""
    if n < 3:
        raise ValueError("three named markers need three ids")
    return [EOT, IM_START, IM_END, *(f"<|reserved_{i}|>" for i in range(n - 3))]


def is_reserved(c: Column) -> Column:
    return c.startswith("<|reserved_") & c.endswith("|>")


def strip_specials(text: Column) -> Column:
    """Without special strings, repeated until none is left; every pass takes away at least one closing mark."""
    passes = F.sequence(F.lit(1), F.lit(1) + F.length(F.regexp_replace(text, r"(?s)(?:(?!\|>).)+", "")))
    return F.when(text.rlike(SPECIAL), F.aggregate(passes, text, lambda t, _: F.regexp_replace(t, SPECIAL, ""))).otherwise(text)


def fold_system(messages: Column) -> Column:
    """User and assistant turns, with the system texts put before the first one if that is the user's. Null contents
    count as empty; without a user turn in front the system text is lost."""
    text = lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))
    turns = F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant")), text)
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    first = lambda t, i: F.struct(t["role"].alias("role"), F.when(i == 0, F.concat(system, F.lit("\n\n"), t["content"])).otherwise(t["content"]).alias("content"))
    return F.when((system != "") & (F.size(turns) > 0) & (F.get(turns, F.lit(0))["role"] == "user"), F.transform(turns, first)).otherwise(turns)


def chat_spans(turns: Column) -> Column:
    """array of (text, is_target): the opening marker, then per turn its header, its content and its end; an assistant's
    content and end are targets."""
    span = lambda text, target: F.struct(text.alias("text"), target.alias("is_target"))

    def of(t: Column) -> Column:
        mine = t["role"] == "assistant"
        return F.array(span(F.concat(F.lit(IM_START), t["role"], F.lit("\n")), F.lit(False)), span(strip_specials(t["content"]), mine), span(F.lit(f"{IM_END}\n"), mine))

    return F.concat(F.array(span(F.lit(EOT), F.lit(False))), F.flatten(F.transform(turns, of)))


def render_prompt(turns: Column) -> Column:
    """The turns as training text, with an assistant's header behind them."""
    return F.concat(F.array_join(F.transform(chat_spans(turns), lambda s: s["text"]), ""), F.lit(f"{IM_START}assistant\n"))


def pair_lengths(turns: Column) -> Column:
    """array of (user-side tokens, second message's header, its content and end, both roles' target flags) is reduced
    here to what splitting needs: per pair its tokens in the byte profile and where its first target begins."""
    tokens = lambda t: F.octet_length(strip_specials(t["content"])) + F.octet_length(t["role"]) + 4
    head = lambda t: F.octet_length(t["role"]) + 2

    def pair(i: Column) -> Column:
        a, b = F.get(turns, 2 * i), F.get(turns, 2 * i + 1)
        return F.struct(
            i.alias("pair"), (tokens(a) + tokens(b)).alias("n"), tokens(a).alias("n_first"),
            F.when(a["role"] == "assistant", head(a)).alias("target_a"), F.when(b["role"] == "assistant", tokens(a) + head(b)).alias("target_b"),
        )

    count = F.floor(F.size(turns) / 2).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), pair)


