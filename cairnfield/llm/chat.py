"""Chat formatting with typed content parts, by DataFrame functions alone.

A turn's content is a text or a list of parts (text, image, audio, document). A visitor turns each part into its piece of the
flat body: texts are escaped, every other part is a placeholder, in order, and what it stands for is recorded beside the body
(kind, reference, tokens that it expands to). A template puts the turns of a conversation into one string and marks,
by code points, what a model is to be trained on.

Control strings (the template's marks and the placeholders) inside texts and roles get a tilde after their first
sign, and those that already have tildes there one more; reading takes one away. So every text comes back as it was, and a
control string that is found in the output is the template's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,tokens:bigint>>"
#: Control strings: a sign, and what follows it. The last group of HELD is all but the tildes.
HELD = r"(<|\[)(~*)((?:/?s|image|audio|document)>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, HELD, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, HELD.replace("(~*)", "~(~*)"), "$1$2$3")


@dataclass(frozen=True)
class Visitor:
    """What each type of part becomes: its piece of the body, and the tokens that it expands to.

    Measures that are missing count as one patch, second or page. A part of another type, or of none, counts as text; null text is empty.
    """

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256
    kinds: tuple[str, ...] = ("image", "audio", "document")

    def image(self, p: Column) -> Column:
        return (F.ceil(F.coalesce(p["width"], F.lit(1)) / self.patch) * F.ceil(F.coalesce(p["height"], F.lit(1)) / self.patch)).cast("long")

    def audio(self, p: Column) -> Column:
        return F.ceil(F.coalesce(p["seconds"], F.lit(1.0)) * self.per_second).cast("long")

    def document(self, p: Column) -> Column:
        return F.coalesce(p["pages"], F.lit(1)).cast("long") * self.per_page

    def piece(self, p: Column) -> Column:
        out = escape(F.coalesce(p["text"], F.lit("")))
        for kind in self.kinds:
            out = F.when(p["type"] == kind, F.lit(f"<{kind}>")).otherwise(out)
        return out

    def tokens(self, p: Column) -> Column:
        out = F.lit(None).cast("long")
        for kind in self.kinds:
            out = F.when(p["type"] == kind, getattr(self, kind)(p)).otherwise(out)
        return out

    def body(self, parts: Column) -> Column:
        return F.array_join(F.transform(parts, self.piece), "")

    def attached(self, parts: Column) -> Column:
        """The parts that have placeholders, in the placeholders' order."""
        others = F.filter(parts, lambda p: F.coalesce(p["type"].isin(*self.kinds), F.lit(False)))
        return F.transform(others, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), self.tokens(p).alias("tokens"))).cast(ATTACHMENTS)

    def parts(self, body: Column, attached: Column) -> Column:
        """The parts again: (type, text, ref); texts between placeholders, empty ones left out, neighbouring texts in one."""
        texts = F.split(body, "<(?:" + "|".join(self.kinds) + ")>", -1)
        text = F.transform(texts, lambda t: F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), F.lit(None).cast("string").alias("ref")))
        other = F.transform(attached, lambda a: F.struct(a["kind"].alias("type"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref")))
        both = F.flatten(F.transform(F.arrays_zip(text.alias("t"), other.alias("o")), lambda x: F.array(x["t"], x["o"])))
        return F.filter(both, lambda p: p.isNotNull() & ((p["type"] != "text") | (p["text"] != "")))


@dataclass(frozen=True)
class Template:
    """Each turn is begin, role, middle, body, end; bodies of the trained roles are under the loss mask."""

    begin: str = "<s>[INST] "
    middle: str = " [/INST] "
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)


def format_conversations(conversations: DataFrame, template: Template = Template(), visitor: Visitor = Visitor()) -> DataFrame:  # noqa: B008
    """One row a conversation: conv_id, formatted, marks, attachments, expanded_tokens.

    Input: conv_id, turn, role, text and, if there is one, parts (PARTS; where it is null, text counts); other columns are left out. Turns
    are in the order of turn (null first), equal turns by role, then body; repeated rows are turns of their own. Null texts and roles are
    empty. Null conv_id is a conversation, too. No rows: no rows. A conversation becomes one value, so it has to fit one (2 GB).

    marks: for each turn, in code points of formatted: begin, and loss_begin and loss_end of its trained body (null: untrained).
    attachments: (turn from 1, kind, ref, tokens) of the placeholders in their order; expanded_tokens: their tokens together.
    """
    words = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), *(F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")))).cast(PARTS)
    parts = F.coalesce(F.col("parts").cast(PARTS), words) if "parts" in conversations.columns else words
    role = F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.isin(*template.trained).alias("trained"), escape(role).alias("role"), parts.alias("parts"))
    rows = rows.select("conv_id", "turn", "trained", "role", visitor.body(F.col("parts")).alias("body"), visitor.attached(F.col("parts")).alias("attached"))
    rows = rows.withColumn("rendered", F.concat(F.lit(template.begin), "role", F.lit(template.middle), "body", F.lit(template.end)))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body", "attached")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum(F.length("rendered").cast("long")).over(so_far) - F.length("rendered")
    lead = F.length("role") + len(template.begin) + len(template.middle)
    placed = rows.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        begin.alias("begin"),
        F.when(F.col("trained"), begin + lead).alias("loss_begin"),
        F.when(F.col("trained"), begin + lead + F.length("body")).alias("loss_end"),
        "rendered",
        "attached",
    )
    turns = F.array_sort(F.collect_list(F.struct("n", "begin", "loss_begin", "loss_end", "rendered", "attached")))
    whole = placed.groupBy("conv_id").agg(turns.alias("turns"))
    with_turn = F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(t["n"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["begin"].alias("begin"), t["loss_begin"].alias("loss_begin"), t["loss_end"].alias("loss_end"))).alias("marks"),
        F.flatten(with_turn).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["tokens"], F.lit(0))))


def read_turns(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns of a formatted conversation: (role, body); the role is unescaped, the body as it stands (unescape(), or Visitor.parts())."""
    inside = F.split(formatted, rf"\Q{template.end}\E", -1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(template.begin) + 1))
        role = F.substring_index(rest, template.middle, 1)
        return F.struct(unescape(role).alias("role"), F.substr(rest, F.length(role) + len(template.middle) + 1).alias("body"))

    return F.transform(F.slice(inside, 1, F.size(inside) - 1), turn)


def read_loss(formatted: Column, marks: Column, template: Template = Template()) -> Column:  # noqa: B008
    """All text under the loss mask, unescaped. Each mark is read inside its own turn, so the work grows with the length alone."""
    inside = F.split(formatted, rf"\Q{template.end}\E", -1)

    def under(piece: Column, m: Column) -> Column:
        cut = F.substr(piece, (m["loss_begin"] - m["begin"] + 1).cast("int"), (m["loss_end"] - m["loss_begin"]).cast("int"))
        return F.coalesce(unescape(cut), F.lit(""))

    return F.array_join(F.zip_with(F.slice(inside, 1, F.size(marks)), marks, under), "")


#: A conversation whose texts are nothing but control strings.
TRIAL = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all conversations and conversation -7, read back from what was formatted."""
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL).alias("text"))
    done = format_conversations(rows.unionByName(trial))
    read = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("marks")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "length(regexp_replace({0}, '" + HELD + r"', '\1~\2\3', 'g'))"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRIAL}' UNION ALL SELECT -7, 1, 'assistant', '{TRIAL}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(Template.begin) + len(Template.middle) + len(Template.end)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
