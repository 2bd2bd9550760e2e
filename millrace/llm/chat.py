"""Chat formatting with a grammar round trip, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """A backslash before each backslash, and after each '<' that '|' follows: no marker is left, and it can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?s)(.)", "$1")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Deterministic parser: array<struct<role, text>>, null if the text isn't of the grammar
    (START role newline body END newline)*, where body has no START and no other END."""
    segments = F.split(formatted, r"<\|im_start\|>")
    tail = F.lit(END + "\n")
    good = F.forall(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: s.endswith(tail) & s.contains("\n") & (F.size(F.split(s, r"<\|im_end\|>")) == 2))
    turns = F.transform(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))),
        lambda s: F.struct(
            F.url_decode(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - F.length(tail))).alias("text"),
        ),
    )
    return F.when((F.element_at(segments, 1) == "") & good, turns)


def format_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (as the parser reads them back from `formatted`), n_turns, loss.

    `loss` is the loss mask: (start, length) of the code points of `formatted` that hold a text of `loss_role`, in
    order, apart from each other, as rendered (escaped where the turn is).

    Rounds of rendering go on until what the parser reads back is identical to the source: first each turn as it is;
    then the turns that didn't come back (they hold markers or backslashes) escaped; then, should the whole conversation
    not come back, all of its turns. A conversation that still differs fails the query. Roles are URL-encoded, which
    leaves plain names as they are. Null roles and texts are empty. Turns go by turn (nulls first), then role and text,
    so that ties and repeated rows have one order; every repeated row is a turn. A null conv_id is a conversation of its
    own. An empty table gives no rows; other columns aren't read. The turns of a conversation are together in one row;
    conversations are what is distributed.
    """
    src = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    name = F.url_encode("r")
    plain = parse(render_turn(name, F.col("x")))
    same = F.coalesce((F.size(plain) == 1) & (plain[0]["role"] == F.col("r")) & (plain[0]["text"] == F.col("x")), F.lit(False))
    src = src.withColumn("n", name).withColumn("b", F.when(same, F.col("x")).otherwise(escape(F.col("x"))))
    size = lambda body: F.length(F.col("n")) + F.length(body) + len(render_marks())
    before = Window.partitionBy("conv_id").orderBy("t", "r", "x").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("i", F.coalesce(F.sum(size(F.col("b"))).over(before), F.lit(0))).withColumn("j", F.coalesce(F.sum(size(escape(F.col("x")))).over(before), F.lit(0)))
    grouped = src.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x", "i", "j", "n", "b"))).alias("s"))
    joined = lambda f: F.array_join(F.transform("s", f), "")
    span = lambda at, body: lambda u: F.struct((u[at] + F.length(u["n"]) + F.lit(len(START) + 1)).alias("start"), F.length(body(u)).cast("long").alias("length"))
    masked = F.filter("s", lambda u: u["r"] == loss_role)
    source = F.transform("s", lambda u: F.struct(u["r"].alias("role"), u["x"].alias("text")))
    first = grouped.withColumn("f0", joined(lambda u: render_turn(u["n"], u["b"]))).withColumn("p0", parse(F.col("f0")))
    done = F.coalesce(F.col("p0") == source, F.lit(False))
    last = first.withColumn("done", done).withColumn("formatted", F.when(F.col("done"), F.col("f0")).otherwise(joined(lambda u: render_turn(u["n"], escape(u["x"])))))
    last = last.withColumn("p1", F.when(F.col("done"), F.col("p0")).otherwise(parse(F.col("formatted"))))
    turns = F.when(F.coalesce(F.col("p1") == source, F.lit(False)), F.col("p1")).otherwise(F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    loss = F.when(F.col("done"), F.transform(masked, span("i", lambda u: u["b"]))).otherwise(F.transform(masked, span("j", lambda u: escape(u["x"]))))
    return last.withColumn("turns", turns).select("conv_id", "formatted", "turns", F.size("turns").cast("long").alias("n_turns"), loss.alias("loss"))


def render_marks() -> str:
    """What a turn has besides its role and its text."""
    return START + "\n" + END + "\n"


def masked_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, cut out of `formatted` and unescaped."""
    return F.array_join(F.transform(loss, lambda u: unescape(F.substr(formatted, (u["start"] + 1).cast("int"), u["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What `format_turns` gives, as counts and digests: turns as the parser reads them, the text that the loss mask cuts
    out of `formatted`."""
    turns = F.array_join(F.transform("turns", lambda u: F.concat(u["role"], F.lit("\n"), u["text"], F.lit("\n"))), "")
    d = formatted.select("conv_id", "n_turns", turns.alias("all"), masked_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return d.select("conv_id", "n_turns", sha("all").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars")
