r"""Chat formatting (operator 4): conversations of typed content parts become one training string each.

A turn holds an ordered list of parts, each ``text``, ``image``, ``audio`` or ``document``. The visitor turns a text
part into its escaped text and any other part into one placeholder, ``<|image|>``, ``<|audio|>`` or ``<|document|>``,
recording its reference, its offset in the string and the tokens it expands to. An unknown kind is a document without
pages. The template is::

    <|turn|>ROLE\nPARTS<|end|>\n

Control strings inside texts are escaped reversibly: after the opening ``<`` or ``[`` of a control string, and of one
that was escaped before, a backslash is put in; reading back takes one away. Beside the template's own marks these are
the marks of other templates (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<|...|>``). In roles, ``%``,
``<``, ``[`` and line ends are percent-encoded.

The loss mask is a list of (start, length) in code points of the string, one for each assistant turn, covering its
parts only.

Turns are ordered by turn number, then role, then text; repeated rows stay. Null role, text and parts count as empty,
null turn numbers come first, and rows with a null conversation id form one conversation of their own. A turn without
parts has an empty body. Turns that are equal in all are interchangeable. A very long text, or a conversation with a
large part of all rows, is one string by nature and bounded by its own row. Rows are gathered by conversation, as the result is one string for each; nothing else is
shuffled. All work is done by built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"

#: What may follow an opening < or [ in a control string. Fixed values.
_CONTROL = r"\|[A-Za-z0-9_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens of media: an image costs one for each 28 x 28 patch, audio 25 a second, a document page 600.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 600


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def _escape_role(role: Column) -> Column:
    for raw, code in _ROLE:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for raw, code in reversed(_ROLE):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def text_part(text: Column) -> Column:
    """The parts column of a plain text."""
    nulls = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()])
    return F.array(part)


def _visit(part: Column) -> Column:
    """struct<body, kind, ref, tokens>: the part's place in the string; kind is null for text."""
    kind = F.coalesce(part["kind"], F.lit("document"))
    kind = F.when(kind.isin("text", "image", "audio"), kind).otherwise("document")
    body = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
    number = lambda c: F.coalesce(part[c], F.lit(0))
    tokens = (
        F.when(kind == "image", F.ceil(number("width") / PATCH) * F.ceil(number("height") / PATCH))
        .when(kind == "audio", F.ceil(number("seconds") * AUDIO_RATE))
        .when(kind == "document", number("pages").cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )
    return F.struct(body.alias("body"), F.when(kind != "text", kind).alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row for each conversation: ``conv``, formatted, n_turns, loss_spans, attachments, expanded_tokens.

    ``parts`` is an array of ``PART``; see ``text_part`` for plain texts.
    """
    visited = rows.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), _visit).alias("parts"),
        ).alias("t"),
    )
    visited = visited.select("conv", "t.turn", "t.role", F.array_join(F.col("t.parts.body"), "").alias("body"), "t.parts")
    head = F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))
    visited = visited.withColumn("piece", F.concat(head, "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = visited.select(
        "conv",
        F.struct(
            F.row_number().over(order).alias("n"),
            (F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length(head)).alias("start"),
            F.length("body").cast("long").alias("length"),
            "role", "piece", "parts",
        ).alias("t"),
    )
    turns = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("placed"))
    masked = F.transform(F.filter("placed", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    def attached(t: Column) -> Column:
        sizes = F.transform(t["parts"], lambda x: F.length(x["body"]).cast("long"))
        return F.filter(
            F.transform(
                t["parts"],
                lambda x, i: F.struct(
                    x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"),
                    (t["start"] + F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda a, b: a + b)).alias("offset"),
                ),
            ),
            lambda x: x["kind"].isNotNull(),
        )

    attachments = F.flatten(F.transform("placed", attached))
    return turns.select(
        F.col("conv").alias(conv),
        F.array_join("placed.piece", "").alias("formatted"),
        F.size("placed").cast("long").alias("n_turns"),
        masked.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_chats(formatted: DataFrame, text: str = "formatted", into: str = "turns") -> DataFrame:
    """Adds ``into``: array<struct<role, text>> read back from the formatted string, texts unescaped."""
    pieces = F.filter(F.split(F.col(text), r"<\|turn\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.locate("\n", x) + 1, F.length(x) - F.locate("\n", x) - len(END) - 1)
    turn = lambda x: F.struct(_unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(body(x)).alias("text"))
    return formatted.withColumn(into, F.transform(pieces, turn))


def loss_texts(formatted: DataFrame, text: str = "formatted", spans: str = "loss_spans", into: str = "loss_texts") -> DataFrame:
    """Adds ``into``: the texts under the loss mask, cut out of the string by its spans and unescaped."""
    cut = lambda s: unescape(F.substring(F.col(text), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.withColumn(into, F.transform(F.col(spans), cut))
