"""Chat formatting: conversations to one templated string each, with attachments and a loss mask.

Turns hold typed content parts. A visitor maps each kind of part to what stands for it in the text:
text is escaped, an image, audio or document part becomes an ordered placeholder and an attachment
record with its reference and the number of tokens that the placeholder expands to. All of it is
built from column expressions.

The template: <|im_start|>role, line feed, content, <|im_end|>, line feed. Inside texts every
"<", any number of backslashes, "|" gets one more backslash, so no control string is left there and
taking one backslash away restores the text.

Defined results: null text, role or reference: empty; null conv_id: a conversation of its own;
turns are ordered by turn (nulls first), then role and content; repeated rows are repeated turns; very long
texts and roles with any characters, NUL included, are kept whole; an empty table gives no conversations.
Columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, CLOSE, PART_MARK = "<|im_start|>", "<|im_end|>", "<|part|>"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _line(c: Column) -> Column:
    """A role on one line: backslashes doubled, line feeds as \\n."""
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unline(c: Column) -> Column:
    """Both escapes undone from left to right: a doubled backslash is passed over whole."""
    return F.array_join(F.transform(F.split(unescaped(c), r"\\\\"), lambda piece: F.replace(piece, F.lit("\\n"), F.lit("\n"))), "\\")


class PartVisitor:
    """What each kind of part becomes. Subclass it for another model's expansion rule."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit_text(self, part: Column) -> Column:
        return escaped(F.coalesce(part["text"], F.lit("")))

    def image_tokens(self, part: Column) -> Column:
        cells = lambda side: F.greatest(F.ceil(F.coalesce(side, F.lit(0)) / self.patch), F.lit(1))
        return (cells(part["width"]) * cells(part["height"])).cast("bigint")

    def audio_tokens(self, part: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate), F.lit(1)).cast("bigint")

    def document_tokens(self, part: Column) -> Column:
        return (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.page_tokens).cast("bigint")

    def tokens(self, part: Column) -> Column:
        kind = part["kind"]
        return F.when(kind == "image", self.image_tokens(part)).when(kind == "audio", self.audio_tokens(part)).when(kind == "document", self.document_tokens(part)).otherwise(F.lit(0).cast("bigint"))

    @staticmethod
    def is_attachment(part: Column) -> Column:
        return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))

    def flatten(self, parts: Column) -> tuple[Column, Column]:
        """(content, attachments) of one turn's parts; placeholders are numbered within the turn."""
        attached = F.transform(F.filter(parts, self.is_attachment), lambda p, i: F.struct(i.alias("slot"), p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), self.tokens(p).alias("n_tokens")))
        slot = lambda i: F.size(F.filter(F.slice(parts, 1, i), self.is_attachment))
        shown = F.transform(parts, lambda p, i: F.when(self.is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), slot(i).cast("string"), F.lit("|>"))).otherwise(self.visit_text(p)))
        return F.array_join(shown, PART_MARK), attached


def text_part(text: Column) -> Column:
    """A parts array of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive), attachments.

    Turn offsets are running sums within the conversation, in the same shuffle as the final grouping.
    """
    content, attached = (visitor or PartVisitor()).flatten(F.col("parts"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(parts_col), F.expr(f"cast(array() as array<{PART}>)")).alias("parts"))
    rows = rows.select("conv", "turn", "role", content.alias("content"), attached.alias("attached"), F.concat(F.lit(OPEN), _line(F.col("role")), F.lit("\n")).alias("head"))
    rows = rows.withColumn("message", F.concat("head", "content", F.lit(f"{CLOSE}\n")))
    before = Window.partitionBy("conv").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("message")).over(before), F.lit(0))
    rows = rows.select("conv", start.alias("start"), "message", (F.col("role") == LOSS_ROLE).alias("loss"), F.length("head").alias("head"), F.length("content").alias("body"), "attached")
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "message", "loss", "head", "body", "attached"))).alias("m"))
    spans = F.transform(F.filter("m", lambda x: x["loss"]), lambda x: F.struct((x["start"] + x["head"]).alias("start"), (x["start"] + x["head"] + x["body"]).alias("end")))
    attachments = F.flatten(F.transform("m", lambda x, i: F.transform(x["attached"], lambda a: F.struct(i.alias("turn"), a["slot"].alias("slot"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return whole.select(F.col("conv").alias(conv_col), F.array_join(F.transform("m", lambda x: x["message"]), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string; parts are joined, placeholders left out."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    messages = F.slice(pieces, F.lit(2), F.size(pieces))
    body = lambda m: F.substring(m, F.instr(m, "\n") + 1, F.length(m) - F.instr(m, "\n") - len(CLOSE) - 1)
    plain = lambda t: F.array_join(F.transform(F.split(F.regexp_replace(t, r"<\|(image|audio|document):\d+\|>", ""), r"<\|part\|>"), unescaped), "")
    return F.transform(messages, lambda m: F.struct(_unline(F.substring(m, F.lit(1), F.instr(m, "\n") - 1)).alias("role"), plain(body(m)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: F.array_join(F.transform(F.split(F.regexp_replace(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), r"<\|(image|audio|document):\d+\|>", ""), r"<\|part\|>"), unescaped), "")), "")
