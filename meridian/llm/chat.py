"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as `### Role: text </turn>` lines. Control strings inside roles and texts are always escaped (a
backslash as two, each character of ### as \\h, the first of </turn> as \\l), so neither occurs but as a mark. The parser is
deterministic: it cuts at ` </turn>` and a line feed, reads the role up to the first `: ` after `### ` and undoes the escapes. The
rendered conversation is parsed and compared to its source; if a turn differs, the colons and line feeds of its conversation's
roles are escaped too (\\c, \\n) and it is parsed again. What still differs raises an error.

Defined results: null text and null role are empty; texts of any length are rendered whole; turns go by turn (null first), then
role and text, so ties have an order; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty
table gives an empty result; other columns are ignored, whatever their names. The rows of one conversation meet in one task, since
its output is one string; all steps are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let

HEAD, SEP, END = "### ", ": ", " </turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Nothing that the parser looks for is left in the result; `role` covers what it looks for in roles only."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\h\\h\\h"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    if role:
        out = F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit(":"), F.lit("\\c"))
    return out


def unescape(text: Column) -> Column:
    """Undo `escape`. Doubled backslashes are cut out first, so none of the other escapes can begin inside one."""

    def part(p):
        for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\n", "\n"), ("\\c", ":")):
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def render(turns: Column, roles: bool) -> Column:
    """The conversation's text from its array of (role, text); `roles` escapes the roles' own conflicts too."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), escape(t["role"], roles), F.lit(SEP), escape(t["text"]), F.lit(END))), "")


def lines(formatted: Column) -> Column:
    """The raw lines of a rendered conversation, without their end marks."""
    cut = F.split(formatted, " </turn>\n", -1)
    return F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """array of (role, text) that the grammar reads from a rendered conversation; a line without a head gives nulls."""

    def read(x):
        ok = x.startswith(F.lit(HEAD)) & (F.instr(x, SEP) > 0)
        at = F.instr(x, SEP)
        role = F.substr(x, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))
        text = F.substr(x, at + F.lit(len(SEP)))
        return F.struct(F.when(ok, unescape(role)).alias("role"), F.when(ok, unescape(text)).alias("text"))

    return F.transform(lines(formatted), read)


def _starts(sizes: Column, block: int = 64) -> Column:
    """The sum of all earlier sizes, for each; sums go by blocks, so the work is linear."""

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def place(sums):
        def start(found, i):
            k = F.floor(i / block).cast("int")
            return F.get(found, k) + total(F.slice(sizes, k * block + 1, i - k * block))

        return let(F.transform(sums, lambda _, k: total(F.slice(sums, 1, k))), lambda found: F.transform(sizes, lambda _, i: start(found, i)))

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))
    sums = F.transform(blocks, lambda k: total(F.slice(sizes, k * block + 1, F.lit(block))))
    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(let(sums, place))


def loss_spans(formatted: Column, roles=("assistant",)) -> Column:
    """array of (turn, start, end): code points of the formatted text that count for the loss, end exclusive: bodies of these roles' turns. turn counts from 0."""

    def spans(ls):
        def place(at):
            def span(x, i):
                head = F.instr(x, SEP)
                counts = unescape(F.substr(x, F.lit(len(HEAD) + 1), head - F.lit(len(HEAD) + 1))).isin(*roles)
                start = (F.get(at, i) + head + F.lit(len(SEP) - 1)).cast("long")
                return F.when(counts, F.struct(i.alias("turn"), start.alias("start"), (F.get(at, i) + F.length(x)).cast("long").alias("end")))

            return F.filter(F.transform(ls, span), lambda s: s.isNotNull())

        return let(_starts(F.transform(ls, lambda x: (F.length(x) + F.lit(len(END))).cast("long"))), place)

    return let(lines(formatted), spans)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (as read), formatted, escaped (whether anything had to be), loss_spans (array of turn, start, end)."""
    one = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    turns = turns.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    tried = turns.withColumn("formatted", render(F.col("turns"), False))
    same = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    again = tried.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(render(F.col("turns"), True)))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string"))
    made = again.withColumn("formatted", checked)
    plain = F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t["role"]) + F.length(t["text"]) + F.lit(len(HEAD + SEP + END)))
    return made.select("conv_id", "turns", "formatted", (F.length("formatted") > plain).alias("escaped"), loss_spans(F.col("formatted")).alias("loss_spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests, all read back from the formatted text and its spans."""
    read = parse(F.col("formatted"))
    turns = F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def under(ls):  # a span ends with its turn, so it is cut from that turn's line
        def cut(s):
            size = (s["end"] - s["start"]).cast("int")
            line = F.get(ls, s["turn"])
            return unescape(F.substr(line, F.length(line) - size + 1, size))

        return F.array_join(F.transform("loss_spans", cut), "")

    loss = let(lines(F.col("formatted")), under)
    return formatted.select(
        "conv_id",
        F.size(read).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
