"""Chat formatting (native): a finite-state machine over roles, a declarative template, loss flags per segment.

Defined results: a null text is empty; a null or unknown role, or a turn that the machine does not allow, leaves the
conversation formatted all the same with ``valid = false`` and ``bad_turn`` naming the first offending turn (unknown
roles use the template's ``other`` entry, the role itself escaped inside the header). Rows that tie on ``turn`` are
ordered by role and text, repeated rows stay, null turns come first. Extra columns are ignored; an empty table gives
an empty one. Texts may be of any length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around each role's text, which roles are learned from, and which role may follow which.

    ``opens[role]`` stands before a text and ``close`` after it; all markers are control strings, and so are the
    strings in ``reserved``: inside texts each gets the escape sign after its first character, and escape signs are
    doubled, so no text can end its own turn and every text can be read back.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"})
    other: str = "<|role|>"
    other_end: str = "<|is|>"
    close: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def controls(self) -> list[str]:
        return sorted({*self.opens.values(), self.other, self.other_end, self.close, *self.reserved}, key=lambda s: (-len(s), s))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}<>/-&~#" else c for c in text)


def escaped(text: Column, t: ChatTemplate) -> Column:
    sign = t.escape.replace("\\", "\\\\").replace("$", "\\$")  # as a replacement string
    out = F.regexp_replace(text, _quoted(t.escape), sign + sign)
    inside = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in t.controls())
    return F.regexp_replace(out, f"(?:{inside})", sign)


def unescaped(text: Column, t: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"(?s){_quoted(t.escape)}(.)", "$1")


def format_chats(rows: DataFrame, template: ChatTemplate | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, n_turns, valid, bad_turn, segments array<struct<text, loss>>, formatted.

    Segments are the template's markers (loss false) and the escaped texts (loss true for learned roles);
    ``formatted`` is their concatenation. One shuffle by conversation; no Python on the executors.
    """
    t = template or ChatTemplate()
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))))
    grouped = rows.groupBy(F.col(key).alias(key)).agg(turns.alias("turns"))

    allowed = {s: [*r] for s, r in t.moves.items()}
    pairs = F.array(*[F.lit(f"{s}>{r}") for s, rs in allowed.items() for r in rs])
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")),
        lambda a, x: F.struct(
            x["role"].alias("state"),
            (a["at"] + 1).alias("at"),
            F.when((a["bad"] < 0) & ~F.array_contains(pairs, F.concat(a["state"], F.lit(">"), x["role"])), a["at"]).otherwise(a["bad"]).alias("bad"),
        ),
    )

    def segments(x: Column) -> Column:
        opening = F.concat(F.lit(t.other), escaped(x["role"], t), F.lit(t.other_end))
        for r, marker in t.opens.items():
            opening = F.when(x["role"] == r, F.lit(marker)).otherwise(opening)
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.learned).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    return (
        grouped.withColumn("walk", walk)
        .select(key, F.size("turns").cast("long").alias("n_turns"), (F.col("walk.bad") < 0).alias("valid"), F.when(F.col("walk.bad") >= 0, F.col("walk.bad")).alias("bad_turn"), F.flatten(F.transform("turns", segments)).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: DataFrame, template: ChatTemplate | None = None, key: str = "conv_id") -> DataFrame:
    """Parse ``formatted`` back into turns array<struct<role, text>> and the unescaped text under the loss mask."""
    t = template or ChatTemplate()
    # no marker can stand in an escaped text, so the closing marker alone parts the turns
    parts = F.split(F.col("formatted"), _quoted(t.close))
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        named = F.substring_index(x, t.other_end, 1)
        role = F.when(F.startswith(x, F.lit(t.other)), unescaped(F.substring(named, len(t.other) + 1, 2**31 - 1), t))
        text = F.when(F.startswith(x, F.lit(t.other)), F.substring(x, F.length(named) + len(t.other_end) + 1, F.lit(2**31 - 1)))
        for r, marker in t.opens.items():
            role = F.when(F.startswith(x, F.lit(marker)), F.lit(r)).otherwise(role)
            text = F.when(F.startswith(x, F.lit(marker)), F.substring(x, len(marker) + 1, 2**31 - 1)).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text, t).alias("text"))

    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    return formatted.select("*", F.transform(parts, turn).alias("turns"), learned.alias("learned"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = read_back(format_chats(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
