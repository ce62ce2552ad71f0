"""Chat messages to prompts and targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import filled, role, stripped, without_mark

MARK = "<text> "
KNOWN = ("user", "assistant", "system")


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written out. The default is the public ChatML format."""

    before: str = "<|im_start|>"
    after_role: str = "\n"
    after: str = "<|im_end|>\n"
    speaker: str = "assistant"

    def turn(self, role_: str, content: str) -> str:
        return f"{self.before}{role_}{self.after_role}{content}{self.after}"

    def opening(self) -> str:
        """What asks the model for its turn."""
        return f"{self.before}{self.speaker}{self.after_role}"

    def wrapper(self, system: str) -> tuple[str, str]:
        """The text before and after the user's content."""
        a, b = (self.turn("system", system) + self.turn("user", "\u0000")).split("\u0000")
        return a, b

    def opening_after(self, turns: str, with_opening: str) -> str:
        """What a template adds to turns written out when it opens the answer; an error where it changes them."""
        if not with_opening.startswith(turns):
            raise ValueError("the template changes the turns before the answer")
        return with_opening[len(turns) :]

    def prefix(self, system: str, user: Column) -> Column:
        a, b = self.wrapper(system)
        return F.concat(F.lit(a), user, F.lit(b))

    def rendered(self, messages: Column) -> Column:
        """Messages (role, content) with the opening of the answer."""
        each = F.transform(messages, lambda m: F.concat(F.lit(self.before), m["role"], F.lit(self.after_role), m["content"], F.lit(self.after)))
        return F.concat(F.array_join(each, ""), F.lit(self.opening()))


def usable(messages: Column) -> Column:
    """Messages with content and a known role, roles in their plain form, contents marked as text."""
    has = F.filter(messages, lambda m: filled(m["content"]).isNotNull() & role(m["role"]).isin(*KNOWN))
    return F.transform(has, lambda m: F.struct(role(m["role"]).alias("role"), F.concat(F.lit(MARK), stripped(m["content"])).alias("content")))


def without_content(messages: Column) -> Column:
    """How many messages have no content."""
    return F.size(F.filter(messages, lambda m: filled(m["content"]).isNull()))


def without_role(messages: Column) -> Column:
    """How many messages have content and an unknown role; content is looked at first."""
    return F.size(F.filter(messages, lambda m: filled(m["content"]).isNotNull() & ~role(m["role"]).isin(*KNOWN)))


def last_answer(messages: Column) -> Column:
    """The place (from 1) of the last assistant message, 0 without one."""
    return F.array_max(F.concat(F.array(F.lit(0)), F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i + 1).otherwise(0))))


def prompt_and_target(df: DataFrame, messages: str = "messages") -> DataFrame:
    """`df` with prompt_messages and target: the last assistant turn and all before it; later turns are dropped.

    Both are null when there is no assistant turn or it is the first. The target comes without its text mark.
    """
    at = last_answer(F.col("__m"))
    out = df.withColumn("__m", usable(F.col(messages))).withColumn("__at", at)
    good = F.col("__at") > 1
    return out.withColumns(
        {
            "prompt_messages": F.when(good, F.slice("__m", 1, F.col("__at") - 1)),
            "target": F.when(good, stripped(without_mark(F.element_at("__m", F.when(good, F.col("__at")))["content"], MARK))),
        }
    ).drop("__m", "__at")


def prompt_text(messages: Column, template: ChatTemplate | None = None) -> Column:
    """The prompt written out, ready for a text answer."""
    t = template or ChatTemplate()
    return F.concat(F.regexp_replace(t.rendered(messages), r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(" " + MARK))


def sft_disposition(
    df: DataFrame, messages: str = "messages", min_prompt: int = 1, min_target: int = 1, max_prompt_tokens: int | None = None,
    max_target_tokens: int | None = None, n_prompt: Column | None = None, n_target: Column | None = None,
) -> DataFrame:
    """`df` (with prompt_messages and target) and the outcome of each row, the first that holds:
    missing_messages, bad_pair, too_short, too_long, written."""
    prompt = prompt_text(F.col("prompt_messages"))
    out = F.when(F.col(messages).isNull() | (F.size(messages) == 0), "missing_messages")
    out = out.when(F.col("target").isNull() | (F.length("target") == 0), "bad_pair")
    out = out.when((F.length(prompt) < min_prompt) | (F.length("target") < min_target), "too_short")
    if max_prompt_tokens is not None:
        out = out.when(n_prompt > max_prompt_tokens, "too_long")
    if max_target_tokens is not None:
        out = out.when(n_target > max_target_tokens, "too_long")
    return df.withColumn("disposition", out.otherwise("written"))
