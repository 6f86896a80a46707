"""Operator 1, chat formatting with typed content parts.

A message holds parts: text, image, audio or document. A visitor has one method for each type, which returns column
expressions: what stands in the prompt, what is recorded of the attachment, and how many tokens the model will see in
its place. The dispatch is one CASE in the plan, so everything runs inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One part. Which fields count depends on type; the rest may be null.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
TYPES = ("text", "image", "audio", "document")


@dataclass(frozen=True)
class PartVisitor:
    """Production parameters: an image costs image_base tokens and image_tile for each started tile of tile pixels
    square, after it is scaled down to fit max_side; audio costs audio_rate a second; a document page_tokens a page.
    Missing or negative measures count as one tile, no time and one page."""

    chars_per_token: int = 4
    image_base: int = 85
    image_tile: int = 170
    tile: int = 512
    max_side: int = 2048
    audio_rate: int = 25
    page_tokens: int = 258

    def visit_text(self, p: Column) -> tuple[Column, Column]:
        # markers that look like ours are broken up, so that a text cannot forge a placeholder or a turn
        text = F.regexp_replace(F.coalesce(p["text"], F.lit("")), r"<\|", "< |")
        return text, F.ceil(F.length(text) / F.lit(self.chars_per_token)).cast("long")

    def visit_image(self, p: Column) -> tuple[Column, Column]:
        w, h = (F.greatest(F.coalesce(p[k], F.lit(1)), F.lit(1)).cast("double") for k in ("width", "height"))
        shrink = F.least(F.lit(1.0), F.lit(float(self.max_side)) / F.greatest(w, h))
        tiles = F.greatest(F.ceil(w * shrink / self.tile), F.lit(1)) * F.greatest(F.ceil(h * shrink / self.tile), F.lit(1))
        return F.lit("image"), (self.image_base + self.image_tile * tiles).cast("long")

    def visit_audio(self, p: Column) -> tuple[Column, Column]:
        return F.lit("audio"), F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * self.audio_rate).cast("long")

    def visit_document(self, p: Column) -> tuple[Column, Column]:
        return F.lit("document"), (F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * self.page_tokens).cast("long")

    def visit(self, p: Column) -> tuple[Column, Column, Column]:
        """(is attachment, text or name of the placeholder, tokens). A part of unknown or null type is read as text."""
        kind = F.lower(F.coalesce(p["type"], F.lit("text")))
        shown, tokens = self.visit_text(p)
        out, cost = None, None
        for name in TYPES[1:]:
            s, t = getattr(self, f"visit_{name}")(p)
            out = F.when(kind == name, s) if out is None else out.when(kind == name, s)
            cost = F.when(kind == name, t) if cost is None else cost.when(kind == name, t)
        return kind.isin(*TYPES[1:]), out.otherwise(shown), cost.otherwise(tokens)


def format_chats(messages: DataFrame, visitor: PartVisitor = PartVisitor()) -> DataFrame:
    """Operator 1. messages: conv_id, turn, role, parts (array of PART; other columns are ignored). One row for each
    conv_id: conv_id, n_messages, prompt, attachments (array of struct place, kind, uri, turn, tokens, in order of
    place from 1), text_tokens, attachment_tokens.

    Messages are in order of turn (null last), then role, then a hash of the content and the content as shown, so that
    ties and repeated rows, which all stay, have one order. A placeholder reads <|image_3|>: kind and place among the attachments of the conversation.
    Each message with a null conv_id is a conversation of its own. A conversation is one row, so its messages must fit into
    a task. A null role is 'unknown'; null, empty or all-null parts give an empty
    message. Parts are joined by line breaks. An empty table gives no rows.
    """
    m = messages.select(
        "conv_id", F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.xxhash64(F.to_json(F.struct("parts"))).alias("c")).alias("at"),
        F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    found = m.select("conv_id", "at", F.transform("parts", lambda p: F.struct(*(c.alias(n) for c, n in zip(visitor.visit(p), ("att", "shown", "tokens"))), p["uri"].alias("uri"))).alias("parts"))
    chat = found.where("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(F.struct("at", "parts"))).alias("ms"))
    # messages that name no conversation are not gathered: there may be any number of them
    chat = chat.unionByName(found.where("conv_id is null").select("conv_id", F.lit(1).cast("long").alias("n_messages"), F.array(F.struct("at", "parts")).alias("ms")))
    # attachments are numbered by position among the attachments of the flattened conversation
    before = F.aggregate(
        "ms", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(F.filter(x["parts"], lambda p: p["att"])))),
    )
    chat = chat.withColumn("before", before)

    def message(x: Column, i: Column) -> Column:
        first = F.col("before")[i]
        shown = F.transform(
            x["parts"],
            lambda p, k: F.when(p["att"], F.concat(F.lit("<|"), p["shown"], F.lit("_"), (first + 1 + F.size(F.filter(F.slice(x["parts"], F.lit(1), k), lambda q: q["att"]))).cast("string"), F.lit("|>"))).otherwise(p["shown"]),
        )
        return F.concat(F.lit("<|im_start|>"), F.regexp_replace(x["at"]["role"], r"<\|", "< |"), F.lit("\n"), F.array_join(shown, "\n"), F.lit("<|im_end|>\n"))

    refs = F.flatten(F.transform("ms", lambda x: F.transform(F.filter(x["parts"], lambda p: p["att"]), lambda p: F.struct(p["shown"].alias("kind"), p["uri"].alias("uri"), x["at"]["turn"].alias("turn"), p["tokens"].alias("tokens")))))
    refs = F.transform(refs, lambda r, i: F.struct((i + 1).alias("place"), r["kind"].alias("kind"), r["uri"].alias("uri"), r["turn"].alias("turn"), r["tokens"].alias("tokens")))

    def total(att: bool) -> Column:
        return F.aggregate(F.flatten(F.col("ms.parts")), F.lit(0).cast("long"), lambda s, p: s + F.when(p["att"] == att, p["tokens"]).otherwise(F.lit(0)))

    return chat.select("conv_id", "n_messages", F.array_join(F.transform("ms", message), "").alias("prompt"), refs.alias("attachments"), total(False).alias("text_tokens"), total(True).alias("attachment_tokens"))


def typed_parts(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages. The table has plain texts only; so that every type is
    met, each line of a text becomes a text part, and an attachment is derived from the numbers of the message: an
    image on turns 0, 4, 8 ... before the text, audio on 1, 5 ... after it, a document on 2, 6 ... before it."""
    k, n = F.pmod(F.col("turn"), F.lit(4)), F.col("conv_id") * 31 + F.col("turn") * 7

    def part(kind: str, text: Column | None = None, **more: Column) -> Column:
        given = {"type": F.lit(kind), "text": text, **more}
        fields = (f.split(":") for f in PART[7:-1].split(","))
        return F.struct(*((given[f] if given.get(f) is not None else F.lit(None)).cast(t).alias(f) for f, t in fields))

    uri = F.concat(F.lit("att://"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    none = F.array().cast(f"array<{PART}>")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: part("text", t))
    image = F.array(part("image", uri=uri, width=100 + F.pmod(n * 97, F.lit(4000)), height=100 + F.pmod(n * 61, F.lit(3000))))
    audio = F.array(part("audio", uri=uri, seconds=F.pmod(n * 13, F.lit(600)) / F.lit(8.0)))
    document = F.array(part("document", uri=uri, pages=1 + F.pmod(n, F.lit(40))))
    lead = F.when(k == 0, image).when(k == 2, document).otherwise(none)
    return conversations.select("conv_id", "turn", "role", F.concat(lead, lines, F.when(k == 1, audio).otherwise(none)).alias("parts"))
