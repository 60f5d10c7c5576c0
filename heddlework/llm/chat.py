"""Chat formatting with a grammar round trip, in built-in functions only.

A conversation is rendered turn by turn. The grammar has one rule for each role:

    user        [INST] text [/INST]
    assistant   <s> text </s>
    others      <<role>> text <</role>>

A text may not hold a control string of the grammar or the escape character, so a turn is
first rendered as it is, parsed again and compared; a text that does not come back, or whose
parse meets a control string, is rendered escaped. Escaping doubles the escape character and
puts it behind every ``[`` and ``<``, which leaves no control string whole; unescaping drops
one escape character of each. The whole conversation is parsed once more, and what callers
get is read from that parse; a conversation that still differed would fail the job.

Turns are ordered by turn, then role, then text; null turns come first. Null roles and texts
are empty. A null conversation id is a conversation of its own. The loss mask covers the texts
of assistants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Control strings, as a pattern without look-around; what a text must not hold unescaped.
CONTROL = r"\[/?INST\]|</?s>|<<|>>"
#: A turn; a body holds no control string, so the first closing string ends it.
TURN = r"(?s)(\[INST\]|<s>|<<[^<>]*>>) (.*?) (\[/INST\]|</s>|<</[^<>]*>>)"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.replace(F.replace(doubled, F.lit("["), F.lit("[" + ESCAPE)), F.lit("<"), F.lit("<" + ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def role_name(role: Column) -> Column:
    """The role as the grammar names it: any character outside letters, digits, _ and - in hex."""
    plain = role.rlike(r"^[A-Za-z0-9_-]*$")
    return F.when(plain, role).otherwise(F.concat(F.lit("x:"), F.hex(F.encode(role, "UTF-8"))))


def role_read(name: Column) -> Column:
    coded = F.decode(F.unhex(F.substring(name, 3, 1 << 30)), "UTF-8")
    return F.when(name.startswith("x:"), coded).otherwise(name)


def render(role: Column, body: Column) -> Column:
    name = role_name(role)
    opened = F.when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("<<"), name, F.lit(">>")))
    closed = F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise(F.concat(F.lit("<</"), name, F.lit(">>")))
    return F.concat(opened, F.lit(" "), body, F.lit(" "), closed)


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of (role, text, closes)."""
    parts = [F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in (1, 2, 3)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("opened", "body", "closed"), strict=True)])

    def turn(t: Column) -> Column:
        named = F.regexp_extract(t["opened"], "^<<(.*)>>$", 1)
        role = (
            F.when(t["opened"] == "[INST]", "user").when(t["opened"] == "<s>", "assistant").otherwise(role_read(named))
        )
        closes = t["closed"] == F.when(t["opened"].startswith("<<"), F.concat(F.lit("<</"), F.substring(t["opened"], 3, 1 << 30))).otherwise(
            F.concat(F.substring(t["opened"], 1, 1), F.lit("/"), F.substring(t["opened"], 2, 1 << 30))
        )
        return F.struct(role.alias("role"), unescape(t["body"]).alias("text"), closes.alias("closes"))

    return F.transform(zipped, turn)


def _round_trips(role: Column, text: Column) -> Column:
    """Does the turn, rendered as it is, parse back to itself and hold no control string?"""
    rendered = render(role, text)
    body = F.regexp_extract(rendered, TURN, 2)
    return (unescape(body) == text) & ~text.rlike(CONTROL) & (F.regexp_extract(rendered, TURN, 0) == rendered)


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted and the turns read back, one row for each conversation.

    ``df`` has conv_id, turn, role, text; other columns are ignored. The turns of a
    conversation meet in one row because the result is one text; they are gathered on the
    map side first.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    source = df.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    body = F.when(_round_trips(F.col("role"), F.col("text")), F.col("text")).otherwise(escape(F.col("text")))
    turns = source.withColumn("rendered", render(F.col("role"), body))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"))
    formatted = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(True).alias("closes"))).alias("source"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "\n").alias("formatted"),
    )
    back = formatted.withColumn("parsed", parse(F.col("formatted")))
    same = F.assert_true(F.col("parsed") == F.col("source"), F.lit("a conversation does not parse back"))
    return back.where(same.isNull()).select("conv_id", "formatted", F.col("parsed").alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """Lengths and digests of what ``format_conversations`` read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""
    )
    return formatted.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
